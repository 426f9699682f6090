"""Plain single-machine versions of the corpus operators, for comparison on small data."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import zstandard


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    width = min(width, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_duplicates(docs, width, percent):
    """{doc_id: (n_shingles, component_id)} from every pair that shares a shingle; docs: distinct (doc_id, text)."""
    sets = {d: shingles(t, width) for d, t in docs}
    by_set = defaultdict(list)
    for d, s in sets.items():
        if s:
            by_set[s].append(d)
    reps = sorted(by_set, key=lambda s: min(by_set[s]))
    holders, links = defaultdict(list), []
    count = defaultdict(int)
    for s in reps:
        for x in s:
            count[x] += 1
    for i, s in enumerate(reps):
        rare = sorted(s, key=lambda x: (count[x], x))[: len(s) - -(-len(s) * percent // 100) + 1]
        near = {j for x in rare for j in holders[x]}
        for j in near:
            both = len(s & reps[j])
            if 100 * both >= percent * (len(s) + len(reps[j]) - both):
                links.append((min(by_set[s]), min(by_set[reps[j]])))
        for x in rare:
            holders[x].append(i)
    links += [(min(ds), d) for ds in by_set.values() for d in ds]
    found = components(sets, links)
    return {d: (len(sets[d]), found[d]) for d in sets}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def quality_counts(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)"""
    w, seen, dup = words(text), set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(windows)
    covered = {i + j for i, x in enumerate(windows) if count[x] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def kept_by_quality(text, quality):
    """The verdict from the module's bands and sizes, chunk by chunk."""
    if quality_counts(text)[5]:
        return False
    raw, compress = text.encode(), zstandard.ZstdCompressor(level=3).compress
    band = lambda bands, n: [b for b in bands if b[0] <= n][-1][1:]
    low, high = band(quality.DOCUMENT_BANDS, len(raw))
    if not low <= len(compress(raw)) / len(raw) <= high:
        return False
    (size,) = band(quality.CHUNK_SIZES, len(raw))
    few = many = at = 0
    while len(raw) >= 256 and at < len(raw):
        end = at + size if len(raw) - at - size >= 256 else len(raw)
        ratio, (low, high) = len(compress(raw[at:end])) / (end - at), band(quality.CHUNK_BANDS, end - at)
        few, many, at = few + (end - at) * (ratio < low), many + (end - at) * (ratio > high), end
    return max(few, many) <= quality.BAD_SHARE * len(raw)


def boilerplate(docs, max_ratio, min_pages):
    """[(text, n_lines, n_dropped)] for [(text, site)]."""
    pages, holding = Counter(site for _, site in docs), Counter()
    for text, site in docs:
        for line in {x for x in (text or "").split("\n") if words(x)}:
            holding[site, line] += 1
    out = []
    for text, site in docs:
        if text is None:
            out.append((None, 0, 0))
            continue
        lines = text.split("\n")
        kept = [x for x in lines if not (holding[site, x] >= min_pages and holding[site, x] > max_ratio * pages[site])]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def personal_spans(text):
    """[(kind, start, end)] straight from the patterns."""

    def luhn(d):
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return sum(v - 9 * (v > 9) for v in doubled) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m)) <= 15]


def received(edges, seeds, rounds=200, damping=0.85):
    """{host: (mass from or through seeds, all mass)} that walks bring from elsewhere; edges {(src, dst): share}."""
    now, total = {h: (0.0, 1 - damping) for h in seeds}, {}
    for _ in range(rounds):
        step = {}
        for (a, b), share in edges.items():
            x, y = now.get(a, (0.0, 0.0))
            f = seeds.get(a, 0.0)
            old = step.get(b, (0.0, 0.0))
            step[b] = (old[0] + damping * share * (x + f * (y - x)), old[1] + damping * share * y)
        for h, (x, y) in step.items():
            old = total.get(h, (0.0, 0.0))
            total[h] = (old[0] + x, old[1] + y)
        now = step
    return total
