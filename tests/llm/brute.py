"""Plain single-process versions of what the corpus operators compute."""

import hashlib
import re
from collections import Counter

WORD = r"[^\x20\x09-\x0D]+"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(raw):
    return hashlib.sha256(raw if isinstance(raw, bytes) else raw.encode()).hexdigest()


def shingle_set(text):
    words = re.findall(WORD, (text or "").translate(FOLD))
    return {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def similar(rows):
    """doc_id to (set size, smallest reachable doc_id)."""
    up, sets, lists = {i: i for i, _ in rows}, {}, {}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for i, text in rows:
        own = shingle_set(text)
        for j, n in Counter(j for g in own for j in lists.get(g, ())).items():
            if 100 * n >= 75 * (len(own) + len(sets[j]) - n):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
        sets[i] = own
        for g in own:
            lists.setdefault(g, []).append(i)
    return {i: (len(sets[i]), root(i)) for i, _ in rows}


def without_repeats(rows, length=50):
    """doc_id to (bytes, removed, runs, digest of what is left); rows in order of doc_id."""
    first, out = {}, {}
    for i, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if first.setdefault(raw[p:p + length], i) < i:
                gone[p:p + length] = b"\1" * length
        left = bytes(b for b, g in zip(raw, gone) if not g)
        out[i] = len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(left)
    return out


def spans_of(patterns, passes, text):
    """Sorted (start, place, end, kind) of the matches that pass."""
    return sorted((m.start(), i, m.end(), kind) for i, (kind, pattern) in enumerate(patterns)
                  for m in re.finditer(pattern, text or "") if passes(kind, m))


def digest(spans):
    return sha(",".join(f"{kind}:{start}:{end}" for start, _, end, kind in spans))


PERSONAL = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
            ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"),
            ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def personal(kind, match):
    digits = [int(c) for c in match[0] if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in match[0].split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(digits[::-1])]
        return 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


SECRETS = (("assign", r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"""
            r"""|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
           ("access", r"AKIA[A-Z0-9]+"), ("hex", r"[0-9a-f]+"))


def secret(kind, match):
    return len(match[2]) >= 6 if kind == "assign" else len(match[0]) >= (20 if kind == "access" else 24)
