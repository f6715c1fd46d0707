"""Plain versions that the operators are held against."""

import re
from collections import defaultdict

import xxhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns with names that the operators use themselves.
CLASH = ["score", "n", "id", "h", "doc", "part", "fp", "_text", "n_words", "n_lines", "rejected", "component_id"]


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def plain_components(fps, distance=4):
    """fps: list of (id, fp) -> id -> least id reachable."""
    distinct = sorted({f for _, f in fps})
    parent = {f: f for f in distinct}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= distance:
                parent[top(a)] = top(b)
    least = defaultdict(list)
    for i, f in fps:
        if i is not None:
            least[top(f)].append(i)
    return [(i, f, min(least[top(f)], default=None)) for i, f in fps]


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_line_dedup(rows, min_docs=10):
    """rows: list of (id, text) -> list of (id, n_lines, n_dropped, kept)."""
    key = lambda line: lowered(line.strip(" \t\n\x0b\x0c\r"))
    seen = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            seen[key(line)].add(i)
    gone = {k for k, v in seen.items() if k and len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in gone]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def plain_hits(text, items, width=13):
    """items: list of (id, text) -> n_words, n_hit, item ids."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    w = words(text)
    hit, found = set(), set()
    for i, t in items:
        v = words(t)
        if i is None or not v:
            continue
        n = min(width, len(v))
        for s in range(len(v) - n + 1):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == v[s : s + n]:
                    hit |= set(range(p, p + n))
                    found.add(i)
    return len(w), len(hit), sorted(found)
