"""The operators' definitions in plain Python, to compare with on small tables."""

from __future__ import annotations

from collections import Counter
import re

import numpy as np

from tallywatch.llm import textarrays as ta

SPACES = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACES.split(text or "") if w]


def grams(text, size=5):
    ws = words(text)
    if len(ws) < size:
        return {tuple(ws)} if ws else set()
    return {tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)}


def near_classes(docs, threshold=0.8):
    """(doc_id, text) rows to {index: class id} and {index: links}."""
    sets = [grams(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if common >= threshold * (len(sets[i]) + len(sets[j]) - common):
                    root[find(i)] = find(j)
                    if sets[i] != sets[j]:
                        links[i] += 1
                        links[j] += 1
    ids = {}
    for i, (doc_id, _) in enumerate(docs):
        r = find(i)
        ids[r] = min(ids.get(r, doc_id), doc_id)
    return {i: ids[find(i)] for i in range(len(docs))}, links


def chunks(text):
    """(first word, words) of every chunk, by the gear hash over the words joined by a space."""
    data = b""
    found = []
    for position, word in enumerate(words(text)):
        h = 0
        for b in data[-16:]:
            h = (2 * h + int(ta.GEAR[b])) % 65536
        if position == 0 or (len(data) >= 16 and h < 1 << 14):
            found.append(position)
        data += word.encode() + b" "
    return list(zip(found, np.diff([*found, len(words(text))]).tolist()))


def dedup(docs, min_words=20):
    """(doc_id, text) rows in order of doc_id to their texts without repeats."""
    seen = set()
    out = []
    for _, text in docs:
        ws = words(text)
        again = []
        for first, n in chunks(text):
            key = tuple(ws[first : first + n])
            again.append((first, n, key in seen))
            seen.add(key)
        removed, run = [], []
        for first, n, repeat in [*again, (len(ws), 0, False)]:
            if repeat:
                run.append((first, n))
                continue
            if sum(n for _, n in run) >= min_words:
                removed.append((run[0][0], run[-1][0] + run[-1][1]))
            run = []
        starts = [m.span()[0] for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")] + [len(text or "")]
        kept, here = "", 0
        for a, b in removed:
            kept += (text or "")[here : starts[a]]
            here = starts[b]
        out.append(text if not removed else kept + text[here:])
    return out


def leaks(text, items, threshold=0.8):
    """Item ids of which some window of item size is similar enough."""
    ws = words(text)
    found = []
    for item_id, item in items:
        own = words(item)
        if not own:
            continue
        size = min(5, len(own))
        bag = Counter(tuple(own[i : i + size]) for i in range(len(own) - size + 1))
        for s in range(max(1, len(ws) - len(own) + 1)):
            window = ws[s : s + len(own)]
            other = Counter(tuple(window[i : i + size]) for i in range(len(window) - size + 1))
            common = sum((bag & other).values())
            if common and common >= threshold * sum((bag | other).values()):
                found.append(item_id)
                break
    return found


def sainte_lague(votes, seats, most):
    held = [0] * len(votes)
    for _ in range(seats):
        open_ = [i for i in range(len(votes)) if held[i] < most[i] and votes[i] > 0]
        if not open_:
            break
        best = max(open_, key=lambda i: (votes[i] / (2 * held[i] + 1), -i))
        held[best] += 1
    return held
