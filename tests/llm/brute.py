"""Plain versions of the similarity operators."""
import re
from collections import Counter, defaultdict

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


class Forest(dict):
    def root(self, x):
        while self[x] != x:
            self[x] = self[self[x]]
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self[max(a, b)] = min(a, b)


def word_shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, min(len(w), 1))))


def components(sets, percent):
    """Root of every key of ``sets``, and the number of links."""
    forest, index, links = Forest((k, k) for k in sets), defaultdict(list), 0
    for key, own in sets.items():
        common = Counter(other for g in own for other in index[g])
        for other, n in common.items():
            if 100 * n >= percent * (len(own) + len(sets[other]) - n):
                links += 1
                forest.join(key, other)
        for g in own:
            index[g].append(key)
    return {k: forest.root(k) for k in sets}, links


def deduplicated_lines(rows, k=8, percent=80):
    """Texts of (order, text) rows without lines similar to an earlier one."""
    has_word = re.compile(r"[^\x20\x09-\x0D]")
    lines = {}
    for _, text in rows:
        for line in (text or "").split("\n"):
            if has_word.search(line):
                lines.setdefault(line, frozenset(line[i : i + k] for i in range(max(1, len(line) - k + 1))))
    number = {line: i for i, line in enumerate(lines)}
    roots, _ = components({number[line]: s for line, s in lines.items()}, percent)
    seen, out = set(), []
    for _, text in rows:
        kept = []
        for line in (text or "").split("\n"):
            if not has_word.search(line):
                kept.append(line)
            elif roots[number[line]] not in seen:
                seen.add(roots[number[line]])
                kept.append(line)
        out.append(None if text is None else "\n".join(kept))
    return out
