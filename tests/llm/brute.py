"""Plain Python versions of the contracts, for small tables."""

import collections
import hashlib
import re

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def counts_as(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def personal_data(text):
    found = [
        (m.start(), order, f"{kind}:{m.start()}:{m.end()}")
        for order, (kind, pattern) in enumerate(KINDS.items())
        for m in re.finditer(pattern, text or "")
        if counts_as(kind, m.group())
    ]
    return [f[2] for f in sorted(found)]


def license_places(text, phrases):
    words = ALNUM.findall((text or "").translate(LOW))
    places, labels = [], set()
    for phrase, label in phrases:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def edited(text, following):
    n = len(text)
    return text[: n - n // 2] + following[: n // 2]


def kept_words(rows):
    """doc_id: (n_words, n_removed, sha256) for rows of distinct ids."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        words = SPACE.findall(text or "")
        gone = [False] * len(words)
        for p in range(len(words) - 19):
            window = tuple(words[p : p + 20])
            if window in seen:
                gone[p : p + 20] = [True] * 20
            seen.add(window)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out[doc_id] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def classes(rows):
    """doc_id: (n_shingles, component_id) for rows of distinct ids."""
    ids, sets = [], []
    for doc_id, text in sorted(rows):
        words = SPACE.findall((text or "").translate(LOW))
        ids.append(doc_id)
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    parent, holders = list(range(len(ids))), collections.defaultdict(list)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, own in enumerate(sets):
        common = collections.Counter(j for s in own for j in holders[s])
        for j, n in common.items():
            if 100 * n >= 75 * (len(own) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for s in own:
            holders[s].append(i)
    return {ids[i]: (len(sets[i]), ids[root(i)]) for i in range(len(ids))}
