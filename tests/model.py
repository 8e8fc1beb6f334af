"""A plain sequential model of the semantics, one record at a time, to test the Spark jobs against."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np

ORG, LOC = "ORGANIZATION", "LOCATION"


def tokens(sentence):
    """Splitting at the tagged entities leaves plain text, tag and name in turn."""
    pieces = re.split(r"<([A-Z]+)>(.+?)</[A-Z]+>", sentence)
    entities = zip(pieces[2::3], pieces[1::3])
    plain = [[(w, "") for w in text.split(" ") if w] for text in pieces[::3]]
    return plain[0] + [t for entity, after in zip(entities, plain[1:]) for t in (entity, *after)]


def vector(window):
    counts = Counter(w for w, _ in window)
    return {t: n / len(window) for t, n in counts.items()}


def segments(sentence, window=5, distance=5):
    if ORG not in sentence or LOC not in sentence:
        return []
    t = tokens(sentence)
    orgs = [i for i, (_, tag) in enumerate(t) if tag == ORG]
    locs = [i for i, (_, tag) in enumerate(t) if tag == LOC]
    out = []
    for a in orgs:
        for b in locs:
            lo, hi = min(a, b), max(a, b)
            if hi - lo <= distance:
                parts = (t[max(0, lo - window) : lo], t[lo + 1 : hi], t[hi + 1 : hi + 1 + window])
                out.append((t[a][0], t[b][0], ORG if a < b else LOC, *(vector(p) for p in parts)))
    return out


def raw_patterns(texts, seeds):
    """In order of sentences, with one entry per occurrence of the organization and seed."""
    out = []
    for s in texts:
        found = segments(s)
        if not found:
            continue
        for org in re.findall(r"<ORGANIZATION>(.+?)</ORGANIZATION>", s):
            for seed_org, seed_loc in seeds:
                if seed_org == org:
                    out += [seg[2:] for seg in found if seg[0] == org and seg[1] == seed_loc]
    return out


def similarity(p, c, plain=False):
    """None where one side has an empty context and the other has not."""
    if p[0] != c[0]:
        return 0.0
    total = 0.0
    for i in (1, 2, 3):
        pv, cv = p[i], c[i]
        if not pv and not cv:
            continue
        if not pv or not cv:
            return None
        norm = sum(w * w for w in cv.values())
        if i == 3 and not plain:
            norm += sum(cv[t] ** 2 for t in pv if t in cv)
        dot = sum(w * cv.get(t, 0.0) for t, w in pv.items())
        total += dot / (math.sqrt(norm) * math.sqrt(sum(w * w for w in pv.values())))
    return total / 3


def centroid(members):
    parts = []
    for i in (1, 2, 3):
        sums = defaultdict(float)
        for m in members:
            for t, w in m[i].items():
                sums[t] += w
        total = sum(sums.values())
        parts.append({t: w / total for t, w in sums.items()})
    return (members[0][0], *parts)


class Sums:
    """Clusters as rows of a matrix of summed weights, one column per part and token."""

    def __init__(self, patterns):
        names = sorted({(i, t) for p in patterns for i in (1, 2, 3) for t in p[i]})
        self.column = {name: k for k, name in enumerate(names)}
        self.part = np.array([i for i, _ in names], int)
        self.rows, self.tags = np.zeros((0, len(names))), []

    def row(self, pattern):
        out = np.zeros(len(self.column))
        for i in (1, 2, 3):
            for t, w in pattern[i].items():
                out[self.column[i, t]] = w
        return out

    def scores(self, pattern, plain):
        """Similarity with every cluster; 0 for another entity order, negative where it is undefined."""
        own, total = self.row(pattern), np.zeros(len(self.rows))
        for i in (1, 2, 3):
            x, c = own[self.part == i], self.rows[:, self.part == i]
            squares = (c**2).sum(axis=1) + (0 if plain or i < 3 else (c**2 * (x > 0)).sum(axis=1))
            filled = c.any(axis=1)
            product = np.sqrt(squares) * np.linalg.norm(x)
            total += np.where(filled & x.any(), c @ x / np.where(product > 0, product, 1), np.where(filled == x.any(), 0, -9))
        return np.where(np.array(self.tags, object) == pattern[0], total / 3, 0.0)


def cluster(items, tau=0.4, plain=False, histogram=None):
    """One pass over ``(pattern, size)``; returns ``[(members, size)]``."""
    sums, members, sizes = Sums([p for p, _ in items]), [], []
    for pattern, size in items:
        scores = sums.scores(pattern, plain)
        best = max(scores, default=0.0)
        if len(scores) and histogram is not None:
            histogram[math.floor(max(best, 0.0) * 10 + 0.5)] += 1
        if best <= tau:
            sums.rows, sums.tags = np.vstack([sums.rows, sums.row(pattern)]), [*sums.tags, pattern[0]]
            members.append([pattern])
            sizes.append(size)
        else:
            at = int(np.argmax(scores))
            sums.rows[at] += sums.row(pattern)
            members[at].append(pattern)
            sizes[at] += size
    return list(zip(members, sizes))


def extract(texts, seeds, iterations=1, min_size=5, tau=0.4, match=0.6, keep=0.9):
    """The whole loop; level 1 is one partition in sentence order, level 2 goes by size."""
    segs = [s for t in texts for s in segments(t)]
    seeds, metrics = list(seeds), []
    for _ in range(iterations):
        raw = raw_patterns(texts, seeds)
        level1 = [(centroid(m), n) for m, n in cluster([(p, 1) for p in raw], tau)]
        level1.sort(key=lambda c: -c[1])
        final = sorted(((centroid(m), n) for m, n in cluster(level1, tau) if n > min_size), key=lambda c: -c[1])
        support, best = defaultdict(lambda: [0, 0]), []
        for org, loc, *context in segs:
            scores = [(similarity(context, p), i) for i, (p, _) in enumerate(final)]
            matched = [(s, -i) for s, i in scores if s is not None and s >= match]
            for _, minus in matched:
                for seed_org, seed_loc in seeds:
                    if seed_org == org:
                        support[-minus][0 if seed_loc == loc else 1] += 1
            if matched:
                s, minus = max(matched)
                best.append((org, loc, -minus, s))
        confidence = {i: p / (p + n) for i, (p, n) in support.items()}
        misses, candidates = {}, 0
        for org, loc, i, s in best:
            if i in confidence:
                candidates += 1
                misses[org, loc] = misses.get((org, loc), 1.0) * (1 - confidence[i] * s)
        found = {}
        for (org, loc), miss in misses.items():
            if 1 - miss > keep:
                found[org] = min(found.get(org, (2, "")), (-(1 - miss), loc))
        seeds = sorted(set(seeds) | {(org, loc) for org, (_, loc) in found.items()})
        metrics.append((len(raw), len(level1), len(final), len(segs), candidates, len(found), len(seeds)))
    return seeds, metrics, {k: 1 - v for k, v in misses.items()}, confidence
