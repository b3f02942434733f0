"""Plain versions of the operators for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def secrets(text):
    rules = (
        ("assign", r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        ("access", "AKIA[A-Z0-9]+", 0, 20),
        ("hex", "[0-9a-f]+", 0, 24),
    )
    found = []
    for k, (kind, pattern, group, least) in enumerate(rules):
        found += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    counts = [sum(f[1] == k for f in found) for k in range(3)]
    return (*counts, sha(",".join(f[2] for f in sorted(found))))


def without_repeats(texts, window):
    words = [WORD.findall(t or "") for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def shingles(text, size):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def groups(texts, size=3, percent=90):
    """Component number (least position) of each text."""
    sets = [shingles(t, size) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    lists = defaultdict(list)
    for i, s in enumerate(sets):
        for j, o in Counter(j for t in s for j in lists[t]).items():
            if 100 * o >= percent * (len(s) + len(sets[j]) - o):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
        for t in s:
            lists[t].append(i)
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def contamination(texts, items, window=13, share=20):
    low = lambda t: ALNUM.findall((t or "").translate(LOWER))
    windows = defaultdict(set)
    for item, text in items:
        w = low(text)
        k = min(window, len(w))
        for s in range(len(w) - k + 1) if k else ():
            windows[tuple(w[s : s + k])].add(str(item))
    out = []
    for text in texts:
        w, hit, found = low(text), set(), set()
        for k in {len(x) for x in windows}:
            for s in range(len(w) - k + 1):
                if (x := tuple(w[s : s + k])) in windows:
                    hit.update(range(s, s + k))
                    found |= windows[x]
        out.append((len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and share * len(hit) >= len(w)))
    return out


def quality(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)
