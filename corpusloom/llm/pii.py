"""Personal data by weak supervision, with DataFrame functions only.

Patterns give spans of four base kinds, which always stay, and further candidates: matches that fail their check,
local phone numbers, national ids, names and secrets. A regex, a gazetteer and a context labeler vote (1 personal, -1
not, 0 abstains) on every span. The votes are counted by combination, a table of bounded size; expectation-maximisation
on it estimates how reliable each labeler is for each kind, and its posteriors train the span classifier: a logistic model of the votes, and log-odds
of what a span looks like and of the words beside it, which also speak where all labelers abstain. It is applied to every candidate as a column
expression. All steps take time in proportion to a text and its spans.
"""

from __future__ import annotations

from collections.abc import Callable, Collection
from itertools import product
from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.values import let
from corpusloom.plans.lineage import cut

BASE = ("email", "ip", "card", "phone")
ADDED = ("localphone", "natid", "name", "secret")
KINDS = BASE + ADDED

# Titles, given names (the commonest of births in English, German, French and Spanish speaking countries), country
# code top-level domains and the first ones of general use, prefixes by which services mark their keys, cue words.
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Mme Mlle Señor Señora".split()
NAMES = """
James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Christopher Lisa Daniel Nancy
Matthew Betty Anthony Sandra Mark Margaret Donald Ashley Steven Kimberly Andrew Emily Paul Donna Joshua Michelle Kenneth Carol Kevin Amanda Brian Melissa George Deborah
Hans Peter Wolfgang Klaus Jürgen Dieter Manfred Uwe Günter Horst Bernd Stefan Andreas Frank Martin Jens Ralf Ursula Karin Helga Sabine Ingrid Renate Monika Petra Gisela Susanne Claudia Birgit Andrea Anna Julia Laura Lena Heike
Jean Pierre Michel Philippe Alain Nicolas Christophe Bernard Christian François Laurent Julien Frédéric Olivier Éric Marie Nathalie Isabelle Sylvie Catherine Françoise Martine Christine Monique Valérie Sophie Céline Camille Chloé
José Antonio Juan Manuel Francisco Luis Javier Miguel Carlos Jesús Alejandro Rafael Pedro Pablo Ángel Sergio Fernando Jorge Alberto María Carmen Josefa Isabel Dolores Pilar Teresa Rosa Cristina Ángeles Antonia Lucía Marta Elena Paula
""".split()
DOMAINS = "com org net edu gov mil int info biz io ai app dev at au be br ca ch cn cz de dk es eu fi fr gr hu ie in it jp kr mx nl no nz pl pt ro ru se sk tr uk us za".split()
KEY_PREFIXES = "AKIA|ASIA|ghp_|gho_|github_pat_|glpat|xoxb|xoxp|AIza|eyJ|sk_live_|sk_test_|rk_live_|SG\\."
CUES = r"(?i)(?:e-?mail|mail to|contact|call|phone|tel|mobile|fax|reach|card|visa|account|ssn|social security|passport|id number|name|address|ip|kontakt|telefon|karte|courriel|carte|correo|tarjeta|llame|token|secret|password|passwd|pwd|api.?key|access.?key|credentials?|bearer)[^\p{L}]{0,12}$"
COUNTER_CUES = r"(?i)(?:version|release|isbn|issn|order|invoice|part|section|figure|table|page|commit|build|doi|rfc|model|serial|sha-?\d*|md5|checksum|digest|etag|hash)[^\p{L}]{0,6}$"

_LOCAL, _WORD = "[A-Za-z0-9._%+-]", rf"(?:(?:{'|'.join(TITLES)})\.|\p{{Lu}}\p{{L}}{{1,30}})"
#: The contract's patterns. A match of the first and third can only begin where its run of characters does, or at the end of the match before;
#: saying so, with possessive repeats, gives the same matches in time linear in the text.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]+)",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "localphone": r"(?<![0-9+-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "natid": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "name": rf"(?<!\p{{L}}){_WORD}(?: {_WORD}){{1,5}}(?!\p{{L}})",
    "secret": r"(?<![A-Za-z0-9_])(?=[0-9_]*+[A-Za-z])(?=[A-Za-z_]*+[0-9])[A-Za-z0-9_]{16,}+",
}
SPAN = "struct<start:int,kind:int,end:int,hit:string,before:string,after:string>"
CHUNK = 128
# What the classifier sees of a span: hashed words before and behind it, kinds of its characters, its length in fours.
WORDS, SHAPES, LENGTHS = 256, 16, 16
LOOKS = 2 * WORDS + SHAPES + LENGTHS
UNIT = 1 << 20  # posteriors are summed as whole numbers, so that sums don't depend on their order


def running(values: Column, step: Callable[[Column, Column], Column], zero: int) -> Column:
    """What ``step``, an associative function, gives over the ints ``values`` up to each of them.

    Results are appended within chunks and then carried over the chunks: appending to one array would copy it for every value.
    """

    def over(v: Column) -> Column:
        return F.aggregate(v, F.array().cast("array<int>"), lambda a, x: F.array_append(a, step(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(zero)), x)))

    def joined(v: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int")), lambda j: over(F.slice(v, j * CHUNK + 1, F.lit(CHUNK))))
        carried = lambda ps, ends: F.flatten(F.transform(ps, lambda p, j: F.transform(p, lambda x: step(F.when(j == 0, F.lit(zero)).otherwise(F.get(ends, j - 1)), x))))
        return let(parts, lambda ps: let(over(F.transform(ps, lambda p: F.element_at(p, -1))), lambda ends: carried(ps, ends)))

    return let(values, lambda v: F.when(F.size(v) > 0, joined(v)).otherwise(F.array().cast("array<int>")))


def _spans(kind: Column, h: Column, g: Column) -> Column:
    """The spans of a kind, from its hits ``h`` and the texts ``g`` around them; positions are code points."""
    ends = running(F.zip_with(F.slice(g, F.lit(1), F.size(h)), h, lambda a, b: F.length(a) + F.length(b)), lambda a, x: a + x, 0)

    def span(e: Column, x: Column, i: Column) -> Column:
        end = F.get(e, i)
        return F.struct((end - F.length(x)).alias("start"), kind.alias("kind"), end.alias("end"), x.alias("hit"), F.right(F.get(g, i), F.lit(40)).alias("before"), F.left(F.get(g, i + 1), F.lit(16)).alias("after"))

    return F.when(F.size(h) > 0, let(ends, lambda e: F.transform(h, lambda x, i: span(e, x, i)))).otherwise(F.array().cast(f"array<{SPAN}>"))


def _named(s: Column, names: Collection[str]) -> Column:
    """Of a run of capitalised words, those from the first title (with up to two more) or given name (with one more); null if there is none."""
    title = lambda w: F.rtrim(w, F.lit(".")).isin(TITLES)

    def part(words: Column) -> Column:
        first = F.get(F.filter(F.sequence(F.lit(0), F.size(words) - 2), lambda i: title(F.get(words, i)) | F.get(words, i).isin(list(names))), F.lit(0))

        def cut_out(i: Column) -> Column:
            size = lambda ws: F.length(F.array_join(ws, " "))
            skipped = F.when(i > 0, size(F.slice(words, F.lit(1), i)) + 1).otherwise(0)
            kept = F.array_join(F.slice(words, i + 1, F.when(title(F.get(words, i)), 3).otherwise(2)), " ")
            start = s["start"] + skipped
            return F.struct(start.alias("start"), s["kind"].alias("kind"), (start + F.length(kept)).alias("end"), kept.alias("hit"), s["before"].alias("before"), s["after"].alias("after"))

        return let(first, lambda i: F.when(i.isNotNull(), cut_out(i)))

    return let(F.split(s["hit"], " "), part)


def _regex_vote(s: Column) -> Column:
    """Structure and checks of the kind; for base kinds 1 exactly where the span stays."""
    hit, digits = s["hit"], F.regexp_replace(s["hit"], "[^0-9]", "")
    part = "0*+(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2}|)"
    ip = hit.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    card = F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    random = hit.rlike("^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$") | hit.rlike("(?:[0-9][A-Za-z_]+){4}") & hit.rlike("[A-Z]") & hit.rlike("[a-z]")
    vote = lambda ok: F.when(ok, 1).otherwise(-1)
    return (
        F.when(s["kind"] == 0, 1)
        .when(s["kind"] == 1, vote(ip))
        .when(s["kind"] == 2, vote(card))
        .when(s["kind"] == 3, vote(F.length(digits).between(9, 15)))
        .when(s["kind"] == 4, vote(digits.rlike("^[2-9][0-9]{2}[2-9]")))
        .when(s["kind"] == 5, vote(~digits.rlike("^(?:000|666|9)|^...00|0000$")))
        .when(s["kind"] == 6, F.when(F.rtrim(F.split(hit, " ")[0], F.lit(".")).isin(TITLES), 1).otherwise(0))
        .otherwise(F.when(random, 1).when(hit.rlike("^[A-Za-z]+_?[0-9]{1,4}$"), -1).otherwise(0))
    )


def _gazetteer_vote(s: Column, names: Collection[str], domains: Collection[str]) -> Column:
    hit = s["hit"]
    return (
        F.when(s["kind"] == 0, F.when(F.lower(F.element_at(F.split(hit, "\\."), -1)).isin(list(domains)), 1).otherwise(0))
        .when((s["kind"] == 1) & hit.rlike(r"^(?:0|10|127|255)\.|^192\.168\."), -1)
        .when(s["kind"] == 2, F.when(hit.rlike("^[3-6]"), 1).otherwise(-1))
        .when((s["kind"] == 3) & hit.rlike(r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"), 1)
        .when((s["kind"] == 6) & F.exists(F.split(hit, " "), lambda w: w.isin(list(names))), 1)
        .when((s["kind"] == 7) & hit.rlike(f"^(?:{KEY_PREFIXES})"), 1)
        .otherwise(0)
    )


def _context_vote(s: Column) -> Column:
    return F.when(s["before"].rlike(CUES), 1).when(s["before"].rlike(COUNTER_CUES), -1).when((s["kind"] < 6) & s["after"].rlike(r"^[0-9\p{L}_]"), -1).otherwise(0)


def _looks(s: Column) -> Column:
    """The four features of a span, numbers below LOOKS, each 12 bits of a long."""
    word = lambda text, pattern: F.pmod(F.crc32(F.lower(F.regexp_extract(text, pattern, 1)).cast("binary")), F.lit(WORDS))
    before, after = word(s["before"], r"(\p{L}+)[^\p{L}]{0,8}$"), word(s["after"], r"^[^\p{L}]{0,8}(\p{L}+)")
    shape = sum((s["hit"].rlike(p).cast("long") * (1 << i) for i, p in enumerate((r"\p{Lu}", r"\p{Ll}", "[0-9]", r"[^\p{L}0-9]"))), F.lit(0))
    length = F.least(F.floor((s["end"] - s["start"]) / 4), F.lit(LENGTHS - 1))
    numbers = (before, after + WORDS, shape + 2 * WORDS, length + 2 * WORDS + SHAPES)
    return sum((n * (1 << 12 * i) for i, n in enumerate(numbers)), F.lit(0)).cast("long")


def voted_spans(docs: DataFrame, keep: Column, names: Collection[str] = NAMES, domains: Collection[str] = DOMAINS) -> DataFrame:
    """``keep`` as kept, and the spans found in text (array of start, kind, end, votes r, g, c, size class, looks), null texts as empty. One scan of the texts."""
    d = docs.select(keep.alias("kept"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("*", *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"h_{k}") for k, p in PATTERNS.items()])
    d = d.select("kept", *[f"h_{k}" for k in KINDS], *[F.when(F.size(f"h_{k}") > 0, F.split("text", p, -1)).alias(f"g_{k}") for k, p in PATTERNS.items()])
    of_kind = F.array(*[F.struct(F.lit(i).alias("kind"), F.col(f"h_{k}").alias("h"), F.col(f"g_{k}").alias("g")) for i, k in enumerate(KINDS)])
    d = d.select("kept", F.flatten(F.transform(of_kind, lambda x: _spans(x["kind"], x["h"], x["g"]))).alias("found"))
    d = d.select("kept", F.filter(F.transform("found", lambda s: F.when(s["kind"] == KINDS.index("name"), _named(s, names)).otherwise(s)), lambda s: s.isNotNull()).alias("found"))

    def votes(s: Column) -> Column:
        size = s["end"] - s["start"]
        return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), _regex_vote(s).alias("r"), _gazetteer_vote(s, names, domains).alias("g"), _context_vote(s).alias("c"), F.when(size <= 10, 0).when(size <= 18, 1).otherwise(2).alias("size"), _looks(s).alias("looks"))

    return d.select("kept", F.array_sort(F.transform("found", votes)).alias("found"))


def reliabilities(table: list[tuple[int, int, int, int, int, float]], rounds: int = 40, pooled: float = 50.0) -> list[float]:
    """Posterior of being personal for each (kind, r, g, c, size, count), by expectation-maximisation over labelers' confusion rates.

    A labeler has rates for each kind, which lean on those over all kinds with the weight of ``pooled`` spans.
    """
    post = [0.9 if r + g + c > 0 else 0.1 if r + g + c < 0 else 0.5 for _, r, g, c, _, _ in table]
    seen = sorted({row[0] for row in table})
    for _ in range(rounds):
        rate = {(k, j, y, v): float(k is None) for k, j, y, v in product((None, *seen), range(3), (0, 1), (-1, 0, 1))}
        prior = {(k, y): 1.0 for k in seen for y in (0, 1)}
        for (k, *votes, _, n), p in zip(table, post):
            for y, w in ((1, p * n), (0, (1 - p) * n)):
                prior[k, y] += w
                for j, v in enumerate(votes):
                    rate[k, j, y, v] += w
                    rate[None, j, y, v] += w
        total = {(k, j, y): sum(rate[k, j, y, v] for v in (-1, 0, 1)) for k, j, y in product((None, *seen), range(3), (0, 1))}

        def chance(k: int, j: int, y: int, v: int) -> float:
            return (rate[k, j, y, v] + pooled * rate[None, j, y, v] / total[None, j, y]) / (total[k, j, y] + pooled)

        for i, (k, *votes, _, _) in enumerate(table):
            z = log(prior[k, 1] / prior[k, 0]) + sum(log(chance(k, j, 1, v)) - log(chance(k, j, 0, v)) for j, v in enumerate(votes))
            post[i] = 1 / (1 + exp(-max(-30.0, min(30.0, z))))
    return post


def features(kind: int, r: int, g: int, c: int, size: int) -> list[float]:
    return [1.0, *(float(kind == k) for k in range(len(KINDS))), *(float(v == x) for v in (r, g, c) for x in (-1, 1)), *(float(size == x) for x in (0, 2))]


def train(table: list[tuple[int, int, int, int, int, float]], post: list[float], rounds: int = 300, l2: float = 0.01, prior: float = 0.5) -> list[float]:
    """Weights of the votes in the span classifier, fitted to the posteriors ``post``. Without spans all candidates get the score of the votes' signs."""
    x = [features(*row[:5]) for row in table]
    w = [0.0] * len(features(0, 0, 0, 0, 0))
    start = [0.0, *[0.0] * len(KINDS), *[-prior, prior] * 3, 0.0, 0.0]
    w = [a + b for a, b in zip(w, start)]
    total = sum(log(1 + n) for *_, n in table) or 1.0
    for _ in range(rounds):
        grad = [l2 * (a - b) for a, b in zip(w, start)]
        for f, p, row in zip(x, post, table):
            z = sum(a * b for a, b in zip(w, f))
            e = log(1 + row[5]) * (1 / (1 + exp(-max(-30.0, min(30.0, z)))) - p) / total
            for i, v in enumerate(f):
                if v:
                    grad[i] += e
        w = [a - 2.0 * b for a, b in zip(w, grad)]
    return w


def look_weights(sums: list[tuple[int, int, int, int]], few: float = 20.0, most: float = 2.0) -> list[float]:
    """Weight of each (kind, look) from sums (kind, look, posteriors in UNITs, spans): the log-odds of being personal with that look against all of the kind.

    Rates lean on the kind's with the weight of ``few`` spans, log-odds are at most ``most``: votes and looks are not independent, so looks shift a score, they don't settle it.
    """
    logit = lambda p: log(p) - log(1 - p)
    out, kinds = [0.0] * (len(KINDS) * LOOKS), {}
    for k, look, p, n in sums:
        if look >= 2 * WORDS + SHAPES:  # every span has one length
            a, b = kinds.get(k, (0, 0))
            kinds[k] = a + p, b + n
    for k, look, p, n in sums:
        all_p, all_n = kinds[k]
        base = (all_p / UNIT + 1) / (all_n + 2)
        out[k * LOOKS + look] = max(-most, min(most, logit((p / UNIT + few * base) / (n + few)) - logit(base)))
    return out


def literal(values: list[float]) -> Column:
    """A constant array of doubles, one expression whatever its size."""
    return F.from_json(F.lit("[" + ",".join(map(repr, values)) + "]"), "array<double>")


def classified(voted: DataFrame, at_least: float = 0.5) -> DataFrame:
    """``voted`` (cut: it is read three times) with its base and added spans (arrays of start, kind, end, ordered) in place of found.

    An added span stays if the classifier gives it ``at_least`` and no base span overlaps it; added spans may overlap one another.
    """
    s = voted.select(F.explode("found").alias("s")).groupBy("s.kind", "s.r", "s.g", "s.c", "s.size").count()
    table = sorted((r["kind"], r["r"], r["g"], r["c"], r["size"], float(r["count"])) for r in s.collect())  # 8 * 27 * 3 rows at most
    post = reliabilities(table)
    w = train(table, post)
    place = lambda k, r, g, c, size: (((k * 3 + r + 1) * 3 + g + 1) * 3 + c + 1) * 3 + size
    # labels of the looks: posteriors of the spans on which a labeler votes
    labels = [0.0] * place(len(KINDS), -1, -1, -1, 0)
    for row, p in zip(table, post):
        labels[place(*row[:5])] = float(round(p * UNIT))
    s = voted.select(F.explode("found").alias("s")).where("s.r <> 0 or s.g <> 0 or s.c <> 0")
    each = F.explode(F.array(*[F.shiftright("s.looks", 12 * i).bitwiseAND(4095).cast("int") for i in range(4)]))
    s = s.select("s.kind", F.get(literal(labels), place(*(F.col(f"s.{v}") for v in ("kind", "r", "g", "c", "size")))).cast("long").alias("p"), each.alias("look"))
    sums = s.groupBy("kind", "look").agg(F.sum("p").alias("p"), F.count(F.lit(1)).alias("n")).collect()  # 8 * LOOKS rows at most
    looks = literal(look_weights(sorted(map(tuple, sums))))
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), by + 1)
    k = 1 + len(KINDS)

    def chance(s: Column) -> Column:
        votes = sum((pick([w[k + 2 * j], 0.0, w[k + 2 * j + 1]], s[v] + 1) for j, v in enumerate("rgc")), F.lit(0.0))
        seen = sum((F.get(looks, s["kind"] * LOOKS + F.shiftright(s["looks"], 12 * i).bitwiseAND(4095).cast("int")) for i in range(4)), F.lit(0.0))
        z = w[0] + pick(w[1:k], s["kind"]) + votes + pick([w[k + 6], 0.0, w[k + 7]], s["size"]) + seen
        return 1 / (1 + F.exp(-z))

    stays = lambda s: (s["kind"] < len(BASE)) & (s["r"] == 1)
    short = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    far = (1 << 31) - 1
    # spans are ordered by start, then base kinds first: a base span over another one ends late among those before, or starts early among those after
    reach = running(F.transform("found", lambda s: F.when(stays(s), s["end"]).otherwise(0)), lambda a, x: F.greatest(a, x), 0)
    ahead = F.reverse(running(F.reverse(F.transform("found", lambda s: F.when(stays(s), s["start"]).otherwise(far))), lambda a, x: F.least(a, x), far))
    out = voted.select("kept", "found", F.transform(F.filter("found", stays), short).alias("base"), reach.alias("reach"), ahead.alias("ahead"))
    free = lambda s, i: (F.get("reach", i) <= s["start"]) & (F.get("ahead", i) >= s["end"])
    return out.select("kept", "base", F.transform(F.filter("found", lambda s, i: ~stays(s) & (chance(s) >= at_least) & free(s, i)), short).alias("added"))


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def personal_data(docs: DataFrame, names: Collection[str] = NAMES, domains: Collection[str] = DOMAINS) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every document.

    Null texts count as empty: no spans, the digest of the empty string. Repeated rows give repeated results; other columns are
    not read, whatever their names; an empty table gives an empty result. A text with many spans takes time in proportion to them.
    ``names`` and ``domains`` are the gazetteer, as literals of the plan.
    """
    c = classified(cut(voted_spans(docs, F.col("doc_id"), names, domains)))
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return c.select(F.col("kept").alias("doc_id"), *map(number, BASE), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "added"))).alias("spans"))


def replaced(text: Column, spans: Column, size: int = 4096) -> Column:
    """``text`` with ``spans`` (ordered) replaced by their kinds in brackets; those that overlap are replaced together, under the first one's kind.

    Pieces are taken from chunks of the text, since a position in a whole text is found by counting characters from its start.
    """
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def piece(chunks: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / size).cast("int")
        near = F.array_join(F.slice(chunks, first + 1, F.floor((b - 1) / size).cast("int") - first + 1), "")
        return F.when(b > a, F.substr(near, a % size + 1, b - a)).otherwise("")

    def build(chunks: Column, reach: Column, n: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(spans) - 1), lambda i: (i == 0) | (F.get(spans, i)["start"] >= F.get(reach, i - 1)))

        def parts(f: Column) -> Column:
            before = lambda i: F.when(i == 0, 0).otherwise(F.get(reach, i - 1))
            each = F.transform(f, lambda i: F.concat(piece(chunks, before(i), F.get(spans, i)["start"]), F.element_at(labels, F.get(spans, i)["kind"] + 1)))
            return F.concat(F.array_join(each, ""), piece(chunks, F.element_at(reach, -1), n))

        return let(first, parts)

    reach = running(F.transform(spans, lambda s: s["end"]), lambda a, x: F.greatest(a, x), 0)
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return let(chunks, lambda c: let(reach, lambda r: build(c, r, F.length(text))))


def redact(docs: DataFrame, names: Collection[str] = NAMES, domains: Collection[str] = DOMAINS) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; n_chars, if there, is counted again; all columns and rows stay.

    Rows travel whole, so columns may have any names; null and empty texts and texts without spans stay as they are, repeated rows are
    redacted alike, an empty table gives an empty one. Rows and their spans are written once: nothing is shuffled but counts of votes and looks.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    c = classified(cut(voted_spans(docs, whole, names, domains)))
    row = F.col("kept")
    spans = c.select("kept", F.array_sort(F.concat("base", "added")).alias("spans"))
    out = spans.select("kept", F.when(F.size("spans") > 0, replaced(row["text"], F.col("spans"))).otherwise(row["text"]).alias("text"))
    number = F.when(out["text"].eqNullSafe(row["text"]), row.getField("n_chars")).otherwise(F.length("text").cast("long")) if "n_chars" in docs.columns else None
    return out.select(*[(F.col("text") if n == "text" else number if n == "n_chars" else row.getField(n)).alias(n) for n in docs.columns])
