"""Plain versions that the pipeline test compares with."""

import re


def keep_lines(rows):
    """Texts after later matches are gone; rows in table order."""
    order = sorted(range(len(rows)), key=lambda r: (rows[r][0], r))
    seen, out = [], {}
    for r in order:
        i, t = rows[r]
        if t is None:
            out[i] = t
            continue
        kept = []
        for line in t.split("\n"):
            s = frozenset(w for w in re.split("[ \t\r\x0b\f]+", line.lower()) if w)
            if not s or not any(5 * len(s & b) >= 4 * len(s | b) for b in seen):
                kept.append(line)
            if s:
                seen.append(s)
        text = "\n".join(kept)
        if len(kept) == len(t.split("\n")) or text.strip():
            out[i] = text
    return out


def closure_of(ids, close):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and close(a, b):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}
