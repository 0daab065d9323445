"""Plain version of the prefix-trie contract, one conversation at a time."""

import hashlib
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_trie(rows):
    """rows: (conv_id, turn, role, text). Returns sorted output tuples of the contract."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn, role or "", text or ""))
    ordered = {c: [(r, t) for _, r, t in sorted(v, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))] for c, v in convs.items()}
    built = {}
    for c in ordered:
        h = zlib.crc32(str(c).encode()) % 4
        base = ordered.get(c - (c % 20 if c >= 0 else -((-c) % 20)), [])
        built[c] = base[:h] + ordered[c][h:]
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for k in nodes:
        if k:
            children.setdefault(k[:-1], []).append(k)
    out = []
    for k, members in nodes.items():
        sub = [x for x in nodes if x[: len(k)] == k]
        leaves = sum(1 for x in sub if x not in children)
        saved = sum((len(nodes[x]) - 1) * (len(WORD.findall(x[-1][1])) if x else 0) for x in sub)
        ends = sorted(c for c in members if len(built[c]) == len(k))
        parent = min(nodes[k[:-1]]) if k else None
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.append((min(members), len(k), parent, len(members), len(children.get(k, [])), leaves, saved, digest))
    return sorted(out, key=repr)
