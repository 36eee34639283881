"""Plain versions of what the operators compute, one text or pair at a time."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import regex
import xxhash

from corpusloom.llm import pii, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def leaders(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def shingle_set(text, n):
    words = words_of(text)
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def joined(texts, n, num, den):
    sets = {i: shingle_set(t, n) for i, t in texts.items()}
    ids = list(texts)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and sets[b] and den * (o := len(sets[a] & sets[b])) >= num * (len(sets[a]) + len(sets[b]) - o)]
    return {i: len(s) for i, s in sets.items()}, leaders(ids, links), links


# ---- personal data ----
CONTRACT = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([ -]?[0-9])+", "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}


def luhn(d):
    return sum((v := int(c) * (1 + k % 2)) - 9 * (v > 9) for k, c in enumerate(d[::-1])) % 10 == 0


def digits_of(hit):
    return re.sub("[^0-9]", "", hit)


def base_ok(kind, hit):
    d = digits_of(hit)
    if kind == "ip":
        return all(int(x) <= 255 for x in hit.split("."))
    return {"email": True, "card": 12 <= len(d) <= 19 and luhn(d or "1"), "phone": 9 <= len(d) <= 15}[kind]


def base_spans(text):
    """(start, kind, end) that stay."""
    return sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(CONTRACT.items()) for m in re.finditer(p, text) if base_ok(kind, m[0]))


def candidates(text):
    """(start, kind, end, hit, before, after) of all kinds."""
    out = []
    for k, kind in enumerate(pii.KINDS):
        last, matches = 0, list(regex.finditer(CONTRACT.get(kind) or pii.PATTERNS[kind], text))
        for m, following in zip(matches, [*(x.start() for x in matches[1:]), len(text)]):
            start, hit, before = m.start(), m[0], text[last : m.start()][-40:]
            last = m.end()
            if kind == "name":
                words = hit.split(" ")
                i = next((i for i, w in enumerate(words[:-1]) if w.rstrip(".") in pii.TITLES or w in pii.NAMES), None)
                if i is None:
                    continue
                start += sum(len(w) + 1 for w in words[:i])
                hit = " ".join(words[i : i + (3 if words[i].rstrip(".") in pii.TITLES else 2)])
            out.append((start, k, start + len(hit), hit, before, text[m.end() : min(m.end() + 16, following)]))
    return out


def votes(kind, hit, before, after):
    name, d = pii.KINDS[kind], digits_of(hit)
    if kind < 4:
        r = 1 if base_ok(name, hit) else -1
    elif name == "localphone":
        r = 1 if re.match("[2-9][0-9]{2}[2-9]", d) else -1
    elif name == "natid":
        r = -1 if d[:3] in ("000", "666") or d[0] == "9" or d[3:5] == "00" or d[5:] == "0000" else 1
    elif name == "name":
        r = int(hit.split(" ")[0].rstrip(".") in pii.TITLES)
    else:
        runs = regex.search("([0-9][A-Za-z_]+){4}", hit) and re.search("[A-Z]", hit) and re.search("[a-z]", hit)
        r = 1 if re.fullmatch("[0-9a-f]{32,}|[0-9A-F]{32,}", hit) or runs else -1 if re.fullmatch("[A-Za-z]+_?[0-9]{1,4}", hit) else 0
    g = 0
    if name == "email":
        g = int(hit.rpartition(".")[2].lower() in pii.DOMAINS)
    elif name == "ip":
        g = -1 if re.match(r"(0|10|127|255)\.|192\.168\.", hit) else 0
    elif name == "card":
        g = 1 if hit[0] in "3456" else -1
    elif name == "phone":
        g = int(bool(re.match(r"\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])", hit)))
    elif name == "name":
        g = int(any(w in pii.NAMES for w in hit.split(" ")))
    elif name == "secret":
        g = int(bool(re.match(pii.KEY_PREFIXES, hit)))
    c = 1 if regex.search(pii.CUES, before) else -1 if regex.search(pii.COUNTER_CUES, before) else -1 if kind < 6 and regex.match(r"[0-9\p{L}_]", after) else 0
    size = len(hit)
    return r, g, c, 0 if size <= 10 else 1 if size <= 18 else 2


def looks(hit, before, after):
    """Hashed words beside a span, its kinds of characters, its length."""
    word = lambda m: zlib.crc32((m[1] if m else "").lower().encode()) % 256
    shape = sum(bool(regex.search(p, hit)) << i for i, p in enumerate((r"\p{Lu}", r"\p{Ll}", "[0-9]", r"[^\p{L}0-9]")))
    return (("before", word(regex.search(r"(\p{L}+)[^\p{L}]{0,8}$", before))), ("after", word(regex.match(r"[^\p{L}]{0,8}(\p{L}+)", after))), ("shape", shape), ("length", min(15, len(hit) // 4)))


def posteriors(spans):
    """EM over single spans (kind, r, g, c): a labeler's rates for a kind lean on those over all kinds by 50 spans."""
    kind, votes_ = np.array([s[0] for s in spans]), np.array([s[1:4] for s in spans]) + 1
    sign = (votes_ - 1).sum(1)
    post = np.where(sign > 0, 0.9, np.where(sign < 0, 0.1, 0.5))
    one = np.eye(3)[votes_]  # span, labeler, vote
    for _ in range(40):
        z = np.zeros(len(spans))
        for y, sgn in ((post, 1), (1 - post, -1)):
            shared = 1 + np.einsum("i,ijv->jv", y, one)
            shared /= shared.sum(1, keepdims=True)
            for k in set(kind.tolist()):
                own = kind == k
                rate = np.einsum("i,ijv->jv", y[own], one[own]) + 50 * shared
                rate /= rate.sum(1, keepdims=True)
                z[own] += sgn * (math.log(1 + y[own].sum()) + np.log(rate[np.arange(3), votes_[own]]).sum(1))
        post = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return post


def vote_model(spans, post):
    """Logistic model of kind, votes and size: 300 steps from a start that follows the votes; a combination weighs the logarithm of its spans."""
    combos = {}
    for s, p in zip(spans, post):
        combos.setdefault(s, [p, 0])[1] += 1
    row = lambda k, r, g, c, z: np.r_[1, np.eye(8)[k], r == -1, r == 1, g == -1, g == 1, c == -1, c == 1, z == 0, z == 2].astype(float)
    x, p = np.array([row(*s) for s in combos]), np.array([v[0] for v in combos.values()])
    n = np.log1p([v[1] for v in combos.values()])
    w = start = np.r_[np.zeros(9), [-0.5, 0.5] * 3, 0, 0]
    for _ in range(300):
        w = w - 2 * (0.01 * (w - start) + x.T @ (n / n.sum() * (1 / (1 + np.exp(-x @ w)) - p)))
    return lambda s: float(row(*s) @ w)


def all_spans(texts, at_least=0.5):
    """For each text its base and its added spans, (start, kind, end); the labelers' reliabilities are those over all texts."""
    found = [[(s, k, e, votes(k, hit, before, after), looks(hit, before, after)) for s, k, e, hit, before, after in candidates(t or "")] for t in texts]
    spans = [(k, *v) for one in found for _, k, _, v, _ in one]
    if not spans:
        return [([], []) for _ in texts]
    post = posteriors(spans)
    score = vote_model(spans, post)
    logit = lambda p: math.log(p / (1 - p))
    sums = defaultdict(lambda: [0.0, 0])
    for (k, r, g, c, _), p, seen in zip(spans, post, (f for one in found for *_, f in one)):
        for look in (*seen, "all") if (r, g, c) != (0, 0, 0) else ():
            sums[k, look][0] += p
            sums[k, look][1] += 1

    def shift(k, look):
        if (k, look) not in sums:
            return 0.0
        (p, n), (all_p, all_n) = sums[k, look], sums[k, "all"]
        base = (all_p + 1) / (all_n + 2)
        return max(-2, min(2, logit((p + 20 * base) / (n + 20)) - logit(base)))

    out = []
    for one in found:
        base = sorted((s, k, e) for s, k, e, v, _ in one if k < 4 and v[0] == 1)
        added = [(s, k, e) for s, k, e, v, f in one if not (k < 4 and v[0] == 1) and 1 / (1 + math.exp(-score((k, *v)) - sum(shift(k, x) for x in f))) >= at_least]
        out.append((base, sorted(x for x in added if not any(b[0] < x[2] and x[0] < b[2] for b in base))))
    return out


def redacted(text, spans):
    out, at, open_until = "", 0, -1
    for s, k, e in sorted(spans):
        if s >= open_until:
            out += text[at:s] + f"[{pii.KINDS[k].upper()}]"
        at = open_until = max(open_until, e)
    return out + text[at:]


# ---- fingerprints ----
ALL = (1 << 64) - 1


def mixed(x):
    x ^= x >> 31
    x = x * 0x9E3779B97F4A7C15 & ALL
    x ^= x >> 29
    x = x * 0xD6E8FEB86659FD93 & ALL
    return x ^ (x >> 32)


def simhash_votes(text):
    """For each bit the votes for it less those against it."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = [xxhash.xxh64_intdigest(w) for w in raw.lower().split()]
    total = [0.0] * simhash.BITS

    def vote(terms, weight):
        for term, times in Counter(terms).items():
            bits = b"".join(mixed(term + j & ALL).to_bytes(8, "little") for j in range(simhash.BITS // 64))
            for k in range(simhash.BITS):
                total[k] += weight * (1 + math.log(times)) * (1 if bits[k // 8] >> (7 - k % 8) & 1 else -1)

    for n, weight in simhash.SIZES:
        terms = []
        for i in range(len(words) - n + 1):
            h = n
            for w in words[i : i + n]:
                h = mixed(h * 0x2545F4914F6CDD1D + w & ALL)
            terms.append(h)
        vote(terms, weight)
    few = max(0.0, 1 - len(words) / simhash.FEW_WORDS)
    if few and len(raw) >= 4:
        vote([mixed(int.from_bytes(raw[i : i + 4], "little")) for i in range(len(raw) - 3)], few)
    return total
