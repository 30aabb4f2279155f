"""Secret scans: candidate strings, then a random forest that removes false positives."""

from __future__ import annotations

import bisect
import hashlib
import json
import math
import random
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import prepare
from strandweave.llm.trees import Forest, random_forest

_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
_QUOTED = re.compile(r"[:=]\s{0,3}[\"'`]([^\s\"'`]{8,})[\"'`]")
_ASSIGNMENT = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|passwd|pwd|credential|api[_-]?key|access[_-]?key|private[_-]?key|auth)[A-Za-z_-]{0,20}\s{0,3}[:=]\s{0,3}([^\s\"'`,;<>]{6,})")
_BLOCK = re.compile(r"-----BEGIN ([A-Z ]{1,40})-----\r?\n((?:[A-Za-z0-9+/=:, -]*\r?\n)+?)-----END \1-----")
_DIGIT = re.compile(r"[0-9]")
_CASE = re.compile(r"[a-z][A-Z]")
_NAMES = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|passwd|pwd|credential|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer)\W{0,3}$")
_HASHES = re.compile(r"(?i)(?:sha-?\d*|md5|checksum|digest|commit|revision|rev|hash|uuid|guid|etag|isbn|id|build)\W{0,4}$")
_ASSIGNED = re.compile(r"[:=]\s{0,3}[\"'`]?$")
_WORDS = """about access account address admin after application auth base before build cache change check class client code commit common config content
controller count create data database date default delete demo description design document domain download email entry error event example file
filter folder format from function general get handler header home host html http icon image import index info input insert install item java key language
length level library license line link list local log login main manager map master message method model module name network node number object open
option order output package page param password path plugin point port post private process product project public query read record release remote
report request resource response result return root sample schema script search secret section select server service session set setting show simple
size source spec sql start state static status storage store stream string style support system table tag target task temp template test text the this
time title token tool tree type update upload user util value version view web window with word work world write your""".split()
_PREFIXES = ("AKIA", "ghp_", "gho_", "xoxb-", "xoxp-", "sk_live_", "sk-", "AIza", "eyJ", "glpat-", "npm_")
FEATURES = (
    "length", "entropy", "digit_share", "upper_share", "symbol_share", "transitions", "vowel_share", "hex", "dictionary", "slashes", "path_before", "extension_after",
    "name_before", "hash_before", "assigned", "quoted", "prefix", "repeats", "digits_only", "dashes", "private_block", "public_block", "words_after",
)
TREES = 60
THRESHOLD = 0.5
TRAINING_LINES = 6000
MAX_FINDINGS = 20_000
DICTIONARY = "word_bpe_49k.json"
WORD_SIZES = (4, 14)


@dataclass
class Model:
    """A forest over FEATURES, and the dictionary that one of them looks words up in."""

    forest: Forest
    words: frozenset[str]

    def scores(self, found: list[tuple[str, int, int]]) -> np.ndarray:
        return self.forest.scores(np.array([features(t, a, b, self.words) for t, a, b in found]).reshape(-1, len(FEATURES)))


def dictionary(path: str | None = None) -> frozenset[str]:
    """Whole words of letters in a public tokenizer's vocabulary, and the words of identifiers above; path is that tokenizer's file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(DICTIONARY)
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    low, high = WORD_SIZES
    return frozenset(w for t in vocabulary if t.endswith("</w>") and (w := t[:-4]).isascii() and w.isalpha() and low <= len(w) <= high) | {w for w in _WORDS if len(w) >= low}


def candidates(text: str) -> list[tuple[int, int]]:
    """Code-point spans of strings worth judging: key blocks over several lines, values assigned to names of secrets, quoted assigned values, and long runs with a digit or changes of case; in this order, where they overlap."""
    out: list[tuple[int, int]] = []
    starts: list[int] = []

    def offer(spans) -> None:
        for a, b in spans:
            i = bisect.bisect_left(starts, a)
            if (i == 0 or out[i - 1][1] <= a) and (i == len(out) or out[i][0] >= b):
                starts.insert(i, a)
                out.insert(i, (a, b))

    if "-----BEGIN " in text:
        offer(m.span(2) for m in _BLOCK.finditer(text))
    if "=" in text or ":" in text:
        offer(m.span(1) for m in _ASSIGNMENT.finditer(text))
        offer(m.span(1) for m in _QUOTED.finditer(text))
    offer(m.span() for m in _RUN.finditer(text) if _DIGIT.search(m.group()) or len(m.group()) >= 20 and len(_CASE.findall(m.group())) >= 3)
    return out


def _kinds(s: str) -> np.ndarray:
    """0 digit, 1 lower, 2 upper, 3 other, of each character."""
    table = np.frombuffer(s.encode("utf-32-le"), np.uint32)
    kinds = np.full(len(table), 3)
    for k, (low, high) in enumerate(((48, 57), (97, 122), (65, 90))):
        kinds[(table >= low) & (table <= high)] = k
    return kinds


def coverage(low: str, words: frozenset[str]) -> float:
    """The share of the characters that some word of the dictionary covers."""
    edge = np.zeros(len(low) + 1, np.int64)
    for n in range(WORD_SIZES[0], min(WORD_SIZES[1], len(low)) + 1):
        for at in range(len(low) - n + 1):
            if low[at : at + n] in words:
                edge[at] += 1
                edge[at + n] -= 1
    return float((np.cumsum(edge[:-1]) > 0).mean())


def features(text: str, start: int, end: int, words: frozenset[str]) -> list[float]:
    """Over the whole candidate, and the text next to it."""
    s, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 40]
    n = len(s)
    low = s.lower()
    counts = Counter(s)
    kinds = _kinds(s)
    share = np.bincount(kinds, minlength=4) / n
    letters = sum(map(str.isalpha, s)) or 1
    name = re.sub(r"[\s:=\"'`>]+$", "", before)
    near = re.findall(r"[a-z]+", after.lower())[:4]
    return [
        min(n, 200), -sum(c / n * math.log2(c / n) for c in counts.values()), share[0], share[2], share[3],
        float((kinds[1:] != kinds[:-1]).sum()) / max(1, n - 1), sum(map(low.count, "aeiou")) / letters,
        float(all(c in "0123456789abcdef" for c in low)), coverage(low, words), s.count("/") / n, float(before[-1:] in ("/", "\\", ".")),
        float(bool(re.match(r"\.[a-z]{2,4}\b|/", after))), float(bool(_NAMES.search(name))), float(bool(_HASHES.search(name))), float(bool(_ASSIGNED.search(before))),
        float(after[:1] in ("\"", "'", "`") and before[-1:] == after[:1]), float(s.startswith(_PREFIXES)), max(counts.values()) / n, float(s.isdigit()), s.count("-") / n,
        float("PRIVATE KEY-----" in before[-20:]), float(bool(re.search("(?:CERTIFICATE|PUBLIC KEY)-----", before[-20:]))), float(sum(w in words for w in near)),
    ]


def labelled_findings(lines: int = TRAINING_LINES, seed: int = 5) -> list[tuple[str, int, int, int]]:
    """(line, start, end, label): generated findings in the forms that scanners report, secret (1) or not (0)."""
    r = random.Random(seed)
    hexes, b62 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    word = lambda: r.choice(_WORDS)
    out = []
    while len(out) < lines:
        name = r.choice(["token", "secret", "password", "api_key", "API_KEY", "access_key", "auth_token", "client_secret", "apikey", "TOKEN", "Token", "SECRET", "private_key"])
        op, q = r.choice([" = ", "=", ": ", ":"]), r.choice(['"', '"', "'", ""])
        upper = r.random() < 0.15
        secret = r.random() < 0.5
        if secret:
            kind = r.randrange(8)
            if kind < 3:
                s = some(hexes, r.choice([32, 40, 40, 48, 64])) if kind < 2 else some(b62, r.randint(20, 44))
            elif kind == 3:
                s = r.choice(["AKIA" + some(b62[:26] + "0123456789", 16), "ghp_" + some(b62, 36), "sk_live_" + some(b62, 24), "glpat-" + some(b62, 20)])
                if r.random() < 0.5:
                    name, op, q = word(), " ", ""
            elif kind == 4:
                s = some(b62 + "+/", r.randint(24, 60)) + r.choice(["", "=", "=="])
            elif kind == 5:
                s, q = some(b62 + "!#%&*?", r.randint(10, 18)), q or '"'
            elif kind == 6:
                s, q, upper = r.choice([some(hexes, r.randint(14, 24)), some(b62, r.randint(8, 16)), word().title()[:5] + some("0123456789!$%", r.randint(2, 4)) + some(b62, 4)]), "", False
                name = r.choice(["password", "passwd", "pwd", "PASSWORD", "secret", "DB_PASSWORD"])
            else:
                s, q, upper, op = "\n".join(some(b62 + "+/", 64) for _ in range(r.randint(3, 25))) + "\n", "", False, "\n"
                name = f"-----BEGIN {r.choice(['RSA ', '', 'EC ', 'OPENSSH '])}PRIVATE KEY-----"
            s = s.upper() if upper else s
            pre, post = f"{name.upper() if upper else name}{op}{q}", name.replace("BEGIN", "END") if kind == 7 else q
        else:
            kind = r.randrange(13)
            q2 = q
            if kind == 0:
                s, pre, q2 = some(hexes, r.choice([32, 40, 64])), r.choice(["commit ", "md5: ", "sha256:", "checksum = ", "rev ", "sha1=", "hash: ", "digest "]), ""
            elif kind == 1:
                s, pre, q2 = "-".join(some(hexes, n) for n in (8, 4, 4, 4, 12)), r.choice(["uuid: ", "id=", "guid ", word() + "/", word() + " "]), ""
            elif kind == 2:
                s, pre, q2 = "/".join(word() for _ in range(r.randint(3, 6))) + str(r.randint(1, 99)), r.choice(["see ", "/", "path: ", "https://"]), ""
            elif kind == 3:
                s, pre, q2 = some("0123456789", r.randint(16, 20)), word() + " ", ""
            elif kind == 4:
                s = r.choice(["x" * 20, "your_" + name + "_here_1", "0" * 32, "changeme12345678", "EXAMPLE_" + some("0123456789", 8), "1234567890123456", "<" + name + "_value_1>", "${" + name.upper() + "_1}"])
                pre, q2 = f"{name}{op}{q or chr(34)}", q or '"'
            elif kind == 5:
                s, pre = "_".join(word() for _ in range(r.randint(3, 5))) + str(r.randint(1, 999)), r.choice([word() + " = ", "def ", ""])
            elif kind == 6:
                s, pre, q2 = "".join(word().title() for _ in range(r.randint(3, 5))) + str(r.randint(1, 9)), r.choice(["class ", "new ", ""]), ""
            elif kind == 7:
                s, pre = "-".join(word() for _ in range(r.randint(3, 5))) + "-" + some("0123456789", 4), r.choice(["version ", "https://", "title: ", ""])
            elif kind == 8:
                s, pre, q2 = some(hexes, r.choice([20, 32, 40])), word() + "/" + word() + "/", ""
            elif kind == 9:
                s, pre, q2 = r.choice(["required", "optional", "string", "getpass()", "None", "hidden", word() + "." + word(), "os.environ[KEY]", word() + "_" + word(), "config." + name, "args." + name]), f"{name}{op}", ""
            elif kind == 10:
                s, pre, q2 = "\n".join(some(b62 + "+/", 64) for _ in range(r.randint(3, 25))) + "\n", f"-----BEGIN {r.choice(['CERTIFICATE', 'PUBLIC KEY', 'RSA PUBLIC KEY'])}-----\n", ""
            elif kind == 11:
                s, pre, q2 = "".join(word().title() for _ in range(r.randint(4, 6))), r.choice(["class ", "import ", "", "new ", "= "]), ""
            else:
                s, pre, q2 = "".join(word().title() for _ in range(r.randint(2, 3))), f"{name}{op}", ""
            pre, post = pre + (q2 if pre and pre[-1] not in "\"'" else ""), pre.strip().replace("BEGIN", "END") if kind == 10 else q2
        left = " ".join(word() for _ in range(r.randint(0, 4)))
        line = f"{left} {pre}"
        tail = ".png" if not secret and kind == 8 else ""
        out.append((f"{line}{s}{post}{tail} {word()}", len(line), len(line) + len(s), int(secret)))
    return out


def fit(findings: list[tuple[str, int, int, int]] | None = None, words: frozenset[str] | None = None) -> Model:
    """A forest from labelled findings (line, start, end, label); the generated ones if none are given."""
    findings = findings or labelled_findings()
    words = words if words is not None else dictionary()
    return Model(random_forest(np.array([features(t, a, b, words) for t, a, b, _ in findings]), np.array([y for *_, y in findings]), trees=TREES), words)


def fit_findings(findings: DataFrame, max_rows: int = MAX_FINDINGS, words: frozenset[str] | None = None) -> Model:
    """A forest from a table of reviewed findings (line, start, stop, label), at most max_rows of them, the lowest by hash. Rows with nulls or spans outside their line are left out; without rows, the generated ones serve."""
    sound = findings.where("line is not null and label is not null and start >= 0 and stop > start and stop <= length(line)")
    got = sound.select("line", "start", "stop", F.col("label").cast("int").alias("label")).orderBy(F.xxhash64("line", "start", "stop"), "line", "start", "stop", "label").limit(max_rows).collect()
    return fit([tuple(r) for r in got], words)


def judged(text: str, model: Model, threshold: float) -> list[tuple[int, int, float]]:
    spans = candidates(text)
    found = []
    for at in range(0, len(spans), 4096):  # so many rows of features at a time
        some = spans[at : at + 4096]
        found += [(a, b, float(p)) for (a, b), p in zip(some, model.scores([(text, a, b) for a, b in some])) if p >= threshold]
    return found


def scan(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, start, stop, score, secret_sha256): one row per secret, in code points.

    Null and empty texts have none; repeated rows report repeatedly; rows with
    a null id report with it; an empty table gives no rows; extra columns are
    ignored.
    """
    prepare(docs.sparkSession)

    def run(batches):
        for b in batches:
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for a, e, p in judged(text or "", model, threshold):
                    out.append((doc, a, e, p, hashlib.sha256(text[a:e].encode()).hexdigest()))
            cols = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "start", "stop", "score", "secret_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, start long, stop long, score double, secret_sha256 string")


def redact(docs: DataFrame, model: Model, threshold: float = THRESHOLD, mark: str = "[SECRET]") -> DataFrame:
    """docs with each secret replaced by mark; n_chars, where there is such a column, follows the text.

    Other columns, whatever their names, and all rows stay, repeated ones and
    those with a null id or text too; an empty table stays empty.
    """
    prepare(docs.sparkSession)
    names = docs.columns

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("text")
            texts = b.column(at).to_pylist()
            found = [judged(t or "", model, threshold) for t in texts]
            for i, spans in enumerate(found):
                for a, e, _ in reversed(spans):
                    texts[i] = texts[i][:a] + mark + texts[i][e:]
            cols = [b.column(i) for i in range(len(names))]
            cols[at] = pa.array(texts, cols[at].type)
            if "n_chars" in names:
                k = names.index("n_chars")
                old = cols[k].to_pylist()
                cols[k] = pa.array([len(t) if f else o for t, f, o in zip(texts, found, old)], cols[k].type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(run, docs.schema)
