"""Plain Python versions of the operators' contracts."""

from __future__ import annotations

import base64
import collections
import hashlib
import re

SPACE, WORD = re.compile(r"[\x20\x09-\x0D]+"), re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, width):
    w = WORD.findall(low(text))
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def linked(rows, width, percent):
    """{id: (set size, smallest linked id)} of (id, text) rows with distinct ids."""
    sets = {i: shingles(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    shared = collections.Counter((a, b) for ids in holders.values() for k, b in enumerate(ids) for a in ids[:k])
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def base_spans(text):
    digits = lambda v: re.sub("[^0-9]", "", v)
    valid = {
        "email": lambda v: True,
        "ip": lambda v: all(int(x) <= 255 for x in v.split(".")),
        "card": lambda v: 16 <= len(digits(v)) <= 19 and luhn(digits(v)),
        "phone": lambda v: 8 <= len(digits(v)) <= 15,
    }
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid[k](m[0])]


def repeats(rows, match=50):
    """{(id, text): (bytes, removed, spans, sha256 of the rest)}; null ids are the largest."""
    order = sorted(((float("inf") if i is None else i), i, (t or "").encode()) for i, t in rows if True) if all(i is not None for i, _ in rows) else sorted(((float("inf") if i is None else i), -1 if i is None else i, (t or "").encode()) for i, t in rows)
    least = {}
    for rank, _, b in order:
        for s in range(len(b) - match + 1):
            least.setdefault(b[s : s + match], rank)
    out = {}
    for rank, i, b in order:
        gone = bytearray(len(b))
        for s in range(len(b) - match + 1):
            if least[b[s : s + match]] < rank:
                gone[s : s + match] = b"\1" * match
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for x in range(len(b)) if gone[x] and (x == 0 or not gone[x - 1]))
        out[(None if rank == float("inf") else i, b)] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def sha1_32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def line_key(line):
    return low(line.strip(" \t\n\v\f\r"))


def cut_lines(rows, least=40, documents=5):
    """[(id, lines, dropped, rest)] of (id, text) rows, in their order; null ids are the smallest."""
    held = collections.defaultdict(list)
    order = lambda i: -(2**63) if i is None else i
    for i, t in rows:
        for k in {line_key(x) for x in (t or "").split("\n")}:
            if len(k) >= least:
                held[k].append(order(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held[line_key(x)]) < documents or max(held[line_key(x)]) == order(i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def word_runs(words):
    """[(start, length, period)] of all maximal runs, by trying every period at every place."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            start, length = i - q, j - i + q
            if length >= max(6, 4 * q) and not any(all(words[x] == words[x - p] for x in range(start + p, start + length)) for p in range(1, q)):
                out.append((start, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words):
    gone = {i for s, n, q in word_runs(words) for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def aligned(a, b, bytes_a, bytes_b):
    """[(A ids, B ids)] of each group, and the linked id pairs, from token ids and their bytes."""
    ends = lambda ids, spelled: [sum(len(spelled[i]) for i in ids[: k + 1]) for k in range(len(ids))]
    end_a, end_b = ends(a, bytes_a), ends(b, bytes_b)
    groups, x, y = [], 0, 0
    for e in sorted(set(end_a) & set(end_b)):
        i, j = end_a.index(e) + 1, end_b.index(e) + 1
        groups.append((a[x:i], b[y:j]))
        x, y = i, j
    return groups, [(p, q) for p, u in zip(a, end_a) for q, v in zip(b, end_b) if u == v]
