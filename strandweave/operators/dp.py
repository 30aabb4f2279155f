"""Affine-gap dynamic programming over byte strings, and lists of edits.

An edit list is a list of [op, length]. M matches, R replaces, I is only in
the read, D only in the reference.
"""

from __future__ import annotations

from strandweave.params import AlignParams

NONE = -(1 << 30)
DIAGONAL, ACROSS, DOWN = 0, 1, 2


def op_score(op: str, n: int, p: AlignParams) -> int:
    return n * p.match if op == "M" else -n * p.replace if op == "R" else p.gap_cost(n)


def edits_score(ops: list, p: AlignParams) -> int:
    return sum(op_score(o, n, p) for o, n in ops)


def push(ops: list, op: str, n: int) -> None:
    """Append, merging with an equal last op."""
    if n <= 0:
        return
    if ops and ops[-1][0] == op:
        ops[-1][1] += n
    else:
        ops.append([op, n])


def joined(*lists: list) -> list:
    out: list = []
    for ops in lists:
        for op, n in ops:
            push(out, op, n)
    return out


def longest_match(ops: list) -> int:
    return max((n for op, n in ops if op == "M"), default=0)


def _fill(q: bytes, r: bytes, p: AlignParams, left: int, right: int, free_end: bool):
    """Rows of (first column, steps, runs) and the final or best cell with its score.

    Cells lie in -left <= column - row <= right. With free_end the best cell
    ends the alignment, indels win ties, and rows stop early; else the corner
    ends it and the diagonal wins ties.
    """
    match, miss, extend, opened = p.match, -p.replace, p.gap_extend, p.gap_open + p.gap_extend
    width, height = len(r), len(q)
    value = [0] + [p.gap_cost(j) for j in range(1, min(width, right) + 1)]
    first = 0
    down = [NONE] * len(value)
    down_run = [0] * len(value)
    rows = [(0, [ACROSS] * len(value), list(range(len(value))))]
    best, cell = 0, None
    for i in range(1, height + 1):
        lo, hi = max(0, i - left), min(width, i + right)
        if lo > hi:
            break
        new_value, new_down, new_run, steps, runs = [], [], [], [], []
        across, across_run = NONE, 0
        before = NONE
        row_best = NONE
        base = q[i - 1]
        for j in range(lo, hi + 1):
            k = j - first
            above = value[k] if 0 <= k < len(value) else NONE
            if j == 0:
                v, step, run = p.gap_cost(i), DOWN, i
                d, d_run = v, i
            else:
                corner = value[k - 1] if 0 <= k - 1 < len(value) else NONE
                v = corner + (match if base == r[j - 1] else miss) if corner > NONE else NONE
                step, run = DIAGONAL, 0
                # only in the reference
                start = before - opened if before > NONE else NONE
                if across > NONE and across - extend >= start and across_run < p.max_intron:
                    across, across_run = across - extend, across_run + 1
                else:
                    across, across_run = start, 1
                if across > NONE and (across > v or free_end and across == v):
                    v, step, run = across, ACROSS, across_run
                # only in the read
                start = above - opened if above > NONE else NONE
                held = down[k] if 0 <= k < len(down) else NONE
                if i > 1 and held > NONE and held - extend >= start and down_run[k] < p.max_gap:
                    d, d_run = held - extend, down_run[k] + 1
                else:
                    d, d_run = start, 1
                if d > NONE and (d > v or free_end and d == v):
                    v, step, run = d, DOWN, d_run
                if v > row_best:
                    row_best = v
                if free_end and v > best:
                    best, cell = v, (i, j)
            new_value.append(v)
            new_down.append(d)
            new_run.append(d_run)
            steps.append(step)
            runs.append(run)
            before = v
            if j == 0:
                across = NONE
        rows.append((lo, steps, runs))
        value, down, down_run, first = new_value, new_down, new_run, lo
        if free_end and row_best < best - p.x_cutoff:
            break
    if not free_end:
        best, cell = value[width - first], (height, width)
    return rows, best, cell


def _trace(rows, cell, q: bytes, r: bytes) -> list:
    i, j = cell
    back: list = []
    while i or j:
        lo, steps, runs = rows[i]
        step, run = steps[j - lo], runs[j - lo]
        if step == ACROSS:
            push(back, "D", run)
            j -= run
        elif step == DOWN:
            push(back, "I", run)
            i -= run
        else:
            push(back, "M" if q[i - 1] == r[j - 1] else "R", 1)
            i, j = i - 1, j - 1
    return back[::-1]


def align_between(q: bytes, r: bytes, p: AlignParams) -> list:
    """Edits that turn all of r into all of q, at the best score: constant, banded or full by the sizes."""
    n, m = len(q), len(r)
    if not n or not m:
        return joined([["I", n]], [["D", m]])
    if n == m == 1:
        return [["M" if q == r else "R", 1]]
    wide = abs(n - m) + 2 * p.band_width + 1 < m
    left = p.band_width + max(0, n - m) if wide else n
    right = p.band_width + max(0, m - n) if wide else m
    rows, _, cell = _fill(q, r, p, left, right, False)
    return _trace(rows, cell, q, r)


def extend(q: bytes, r: bytes, p: AlignParams) -> tuple[list, int]:
    """Best-scoring edits from the start of both strings; none if nothing scores over 0."""
    band = 2 * p.band_width
    rows, best, cell = _fill(q, r, p, band, band, True)
    return (_trace(rows, cell, q, r), best) if cell else ([], 0)
