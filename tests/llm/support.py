"""Near copies by brute force."""

import re

import numpy as np

from strandweave.llm.simhash import fingerprint_bytes


def brute_components(rows, k, radius=4, similarity=0.8):
    """Sets of ids that are linked by fingerprints or by shared shingles, over all pairs."""
    ids = [i for i, _ in rows]
    fp = np.array([fingerprint_bytes((t or "").encode(), k) for _, t in rows], np.uint64)
    label = np.arange(len(ids))
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius
    words = [re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) for _, t in rows]
    sets = [{tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set() for w in words]
    for a in range(len(ids)):
        for b in range(a):
            if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) >= similarity * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if both >= similarity * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                    near[a, b] = near[b, a] = True
    for start in range(len(ids)):
        if label[start] == start:
            group, todo = {start}, [start]
            while todo:
                for y in np.flatnonzero(near[todo.pop()]).tolist():
                    if y not in group:
                        group.add(y)
                        todo.append(y)
            label[list(group)] = start
    return [{ids[i] for i in np.flatnonzero(label == s)} for s in np.unique(label)]
