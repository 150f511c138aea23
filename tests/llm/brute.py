"""Plain versions of the operators, one row after the other."""

from __future__ import annotations

import re


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def roots(nodes, links):
    """node -> the smallest node it is linked with."""
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def line_words(line: str) -> str:
    """The words by which a line is compared; blank lines have none."""
    words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", lower(line)) or re.findall(r"[^ \t-\r]+", lower(line))
    return re.sub("[0-9]", "0", " ".join(words)) if len(words) >= 5 else " ".join(words)


def similar_lines(forms, distance, similarity: float):
    """Pairs of different forms whose edit similarity is similarity or more."""
    forms = sorted(set(forms))
    out = []
    for i, a in enumerate(forms):
        for b in forms[:i]:
            longer = max(len(a), len(b))
            if min(len(a), len(b)) >= similarity * longer - 1e-9 and 1 - distance(a, b) / longer >= similarity - 1e-9:
                out.append((a, b))
    return out


def line_removals(docs: dict, distance, similarity: float) -> dict:
    """doc_id -> the lines that go; docs: doc_id -> text."""
    places: dict[str, list] = {}
    for doc_id, text in docs.items():
        for n, line in enumerate((text or "").split("\n")):
            if line_words(line):
                places.setdefault(line_words(line), []).append((doc_id, n))
    groups: dict[str, list] = {}
    for c, root in roots(sorted(places), similar_lines(places, distance, similarity)).items():
        groups.setdefault(root, []).extend(places[c])
    out: dict = {}
    for group in groups.values():
        for doc_id, n in sorted(group)[1:]:
            out.setdefault(doc_id, []).append(n)
    return {d: sorted(set(lines)) for d, lines in out.items()}


def walk(text: str, bits, classes) -> list[tuple[int, int]]:
    """Of a random walk that reads the text, the place that the pointer is at in each step."""
    out, at, step = [], 0, 0
    signs = classes(text)
    while at < len(text):
        out.append((step, at))
        at += bits(step, signs[at])
        step += 1
    return out


def shingle_set(text: str | None) -> frozenset:
    words = [w for w in re.split("[ \t-\r]+", lower(text or "")) if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def near_components(docs: dict, percent: int) -> dict:
    sets = {d: shingle_set(t) for d, t in docs.items()}
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return roots(ids, links)
