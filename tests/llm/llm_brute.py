"""Plain versions of what the operators compute."""

import re


def letters_of(text):
    """Runs of letters in lower case."""
    out, run = [], ""
    for c in text.lower() + " ":
        if c.isalpha():
            run += c
        elif run:
            out.append(run)
            run = ""
    return out


def phrases_by_search(word, words):
    """Greedy longest matches of a padded word in padded words, by substring search."""
    reference, left, count = [f" {w} " for w in words], f" {word} ", 0
    while left:
        size = max([n for n in range(1, len(left) + 1) if any(left[:n] in r for r in reference)], default=1)
        left, count = left[size:], count + 1
    return count


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text):
    """``(start, number, end, kind)`` in order."""
    out = []
    for number, (kind, pattern) in enumerate([("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE)]):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), number, m.end(), kind))
    return sorted(out)


def shingles(text, k):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def near_groups(texts, k, percent):
    """Row number → least row number that links lead to."""
    sets = [shingles(t, k) for t in texts]
    parent = list(range(len(sets)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) * 100 >= percent * max(len(sets[a]), len(sets[b])):
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return [find(a) for a in range(len(sets))], [len(s) for s in sets]
