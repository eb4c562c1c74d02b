"""The operators' contracts in plain Python, for small inputs."""

import re
import zlib
from hashlib import sha256

SPACE = re.compile(r"[\x20\x09-\x0D]+")
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [w for w in SPACE.split((text or "").translate(A_Z)) if w]


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(A_Z))


def remainder(doc_id, modulus):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus


def shingles(text, width=5):
    got = words(text)
    if not got:
        return frozenset()
    return frozenset(tuple(got[i : i + width]) for i in range(max(1, len(got) - width + 1)))


def near(docs, percent=75):
    """(doc_id, n_shingles, component_id) of rows (doc_id, text) with distinct ids."""
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * shared >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    smallest = {}
    for i, (doc_id, _) in enumerate(docs):
        smallest[find(i)] = min(doc_id, smallest.get(find(i), doc_id))
    return [(d, len(sets[i]), smallest[find(i)]) for i, (d, _) in enumerate(docs)]


def exact(docs):
    """(doc_id, keep_id, group_size, kept, text_sha256) of rows (doc_id, text)."""
    groups = {}
    for at, (doc_id, text) in enumerate(docs):
        key = SPACE.sub("", text or "")
        order = (-len(text or ""), doc_id is None, 0 if doc_id is None else doc_id, at)
        groups.setdefault(key, []).append((order, at))
    out = []
    for key, members in groups.items():
        _, best = min(members)
        out += [
            (docs[at][0], docs[best][0], len(members), at == best, sha256(key.encode()).hexdigest())
            for _, at in members
        ]
    return out


def contamination(docs, items, width=13):
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    windows = {}
    for item_id, text in items:
        got = item_words(text)
        n = min(width, len(got))
        for i in range(len(got) - n + 1 if got else 0):
            windows.setdefault(tuple(got[i : i + n]), set()).add("" if item_id is None else str(item_id))
    out = []
    for doc_id, text in docs:
        got, hit, found = item_words(text), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(got) - n + 1):
                if (ids := windows.get(tuple(got[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= ids
        digest = sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(got), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(got)))
    return out
