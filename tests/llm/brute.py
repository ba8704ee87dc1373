"""Plain versions of the operators, for small inputs."""

import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text, size=5):
    w = words(text)
    if len(w) >= size:
        return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
    return {tuple(w)} if w else set()


def near_duplicates(rows):
    """{doc_id: (n_shingles, component_id)} by comparing all pairs that share a shingle."""
    sets = {k: shingles(t) for k, t in rows}
    by, pairs = {}, set()
    for k, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(k)
    for ks in by.values():
        for i, a in enumerate(ks):
            for b in ks[i + 1 :]:
                pairs.add((min(a, b), max(a, b)))
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        n = len(sets[a] & sets[b])
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {k: (len(s), find(k)) for k, s in sets.items()}


def dedup_lines(rows, min_words=50):
    """{doc_id: (n_lines, n_removed, text)}: every stretch with enough words and an earlier copy loses its lines."""
    docs = [(k, (t or "").split("\n")) for k, t in sorted(rows)]
    first, gone = {}, {k: set() for k, _ in docs}
    counts = [[len(re.findall(r"[^\x20\x09-\x0D]+", line)) for line in lines] for _, lines in docs]
    seen = {}
    for _, lines in docs:
        for line in lines:
            seen[line] = seen.get(line, 0) + 1
    for (k, lines), n in zip(docs, counts, strict=True):
        for i in range(len(lines)):
            total = 0
            for j in range(i, len(lines)):
                if seen[lines[j]] < 2:
                    break
                total += n[j]
                if total >= min_words:
                    if first.setdefault(tuple(lines[i : j + 1]), (k, i)) == (k, i):
                        continue
                    gone[k].update(range(i, j + 1))
    return {k: (len(lines), len(gone[k]), "\n".join(x for i, x in enumerate(lines) if i not in gone[k])) for k, lines in docs}


def tile_coverage(doc, item, least=5):
    """Greedy string tiling as published: all longest matches, marked in order of their places, again and again."""
    d, q = words(doc), words(item)
    least = min(least, len(q))
    marked_d, marked_q = [False] * len(d), [False] * len(q)
    while q:
        longest, found = least, []
        for p in range(len(d)):
            for k in range(len(q)):
                n = 0
                while p + n < len(d) and k + n < len(q) and d[p + n] == q[k + n] and not marked_d[p + n] and not marked_q[k + n]:
                    n += 1
                if n > longest:
                    longest, found = n, [(p, k)]
                elif n == longest:
                    found.append((p, k))
        if not found:
            break
        for p, k in found:
            if not any(marked_d[p : p + longest]) and not any(marked_q[k : k + longest]):
                marked_d[p : p + longest] = [True] * longest
                marked_q[k : k + longest] = [True] * longest
    return sum(marked_q) / len(q) if q else 0.0


def section_counts(text, spans, rule="first"):
    """Tokens of each line from a tokenizer's character spans."""
    lines = (text or "").split("\n")
    ends, at = [], 0
    for i, line in enumerate(lines):
        at += len(line) + (i < len(lines) - 1)
        ends.append(at)
    if len(ends) > 1 and ends[-1] == ends[-2]:
        ends.pop()
    counts = [0] * len(ends)
    for a, b in spans:
        place = a if rule == "first" else b - 1
        counts[next(i for i, e in enumerate(ends) if place < e)] += 1
    return counts
