"""Plain versions of the operators, to hold results against."""

import binascii
import re
from itertools import pairwise

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def fold(doc_id, modulus):
    return binascii.crc32(str(doc_id).encode()) % modulus


def shingles(text, width):
    w = words(lower(text))
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def quality(text):
    w = words(text)
    seen, places = {}, set()
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            places.update(p + k for p in at for k in range(3))
    lines = [x for x in (text or "").split("\n") if words(x)]
    failed = len(w) < 50 or 100 * len(places) > 50 * len(w)
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(places), failed


def gapless(spans, capacity):
    """Whether (offset, length) spans fill a sequence from 0 without gap or overlap."""
    spans = sorted(spans)
    return spans[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in pairwise(spans)) and sum(spans[-1]) <= capacity
