"""Personal data by weak supervision (operator 4).

Four kinds have a base pattern each; its valid matches always count. What the
method adds is chosen from looser proposals: obfuscated addresses, other address
and number formats, matches of a base pattern that fail its check, and a fifth
kind, ``secret``: long runs of letters and digits such as keys and tokens.

Four labelers vote for, against or not at all on every span: its format, a
gazetteer (country domains, dial codes, issuer digits, known forms of keys),
the ``CONTEXT`` characters before it, and what it borders on, which can only
speak against it. Expectation-
maximisation over the counts of vote patterns estimates how far each can be
trusted, by kind; a logistic classifier over votes and shape is then trained on
the posteriors and decides which proposed spans are added.

Only built-in functions touch rows. The two fits run on counts of patterns, whose
number is bounded by the labelers (``MOST_PATTERNS``), not by the data.

Offsets come from cutting a text at its matches and adding up the lengths, in
two levels, so long lists of matches stay cheap. Patterns are possessive and
tied to the start of a run, which keeps their matches and makes them linear.

Edge cases: a null text has no spans; repeated rows and null ids each get their
row; texts of any length are searched whole; a proposed span that overlaps a base
span of its kind gives way to it; of two proposals that overlap both go; spans
with an equal start are in order of kind, then end; an empty table gives an empty
result and no fit; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, written

KINDS = ("email", "ip", "card", "phone", "secret")
#: The base patterns, with possessive repeats where nothing that follows could match less.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser forms of the same kinds.
LOOSE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++ ?[\[({] ?(?:at|AT) ?[\])}] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[({] ?(?:dot|DOT) ?[\])}]) ?[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9A-Fa-f]{1,4}:)(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?=[0-9])(?<![0-9./])[0-9]{4}(?:[./][0-9]{4}){3}(?![0-9./])",
    "phone": r"(?=[(0-9])(?<![0-9+(.-])(?<!\+[0-9]{1,3} ?)(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
    "secret": r"(?=[A-Za-z0-9])(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{20,}+",
}
#: What a text must hold for the pattern to be tried.
NEEDS = {"email": "@", "phone": "+"}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
GAZETTEER = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|info|io|co|de|fr|es|uk|eu|it|nl|ch|at|us|ca|au|in|jp|cn|ru|br)$",
    "ip": r"^(?:(?!0|127\.)0*(?:22[0-3]|2[01][0-9]|1[0-9]{2}|[0-9]{1,2})\.|2[0-9A-Fa-f]{3}:)",
    "card": r"^[3-6]",
    "phone": r"^(?:\+(?:1|7|20|27|3[0-469]|4[0-13-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|\(?[2-9])",
    "secret": r"^(?:gh[pousr]_|sk-|pk-|xox[abprs]-|AKIA|ASIA|AIza|eyJ|glpat-|[0-9a-f]{32}$|[0-9a-f]{40}$|[0-9a-f]{64}$|[0-9A-F]{32}$|[0-9A-F]{40}$|[0-9A-F]{64}$)",
}
FOR = {
    "email": r"(?i)(?:mail|contact|kontakt|correo|courriel|write|reach)",
    "ip": r"(?i)(?:\bip\b|address|adresse|host|server|client|login|from)",
    "card": r"(?i)(?:card|karte|carte|tarjeta|visa|credit|pay)",
    "phone": r"(?i)(?:tel|phone|call|fax|mobil|handy|llam|appel)",
    "secret": r"(?i)(?:token|secret|passw|pwd|api.?key|access.?key|auth|bearer|credential)",
}
AGAINST = r"(?i)(?:version|isbn|serial|order|invoice|sha|hash|token|secret|ref\b|build|doi)"
AGAINST_SECRET = r"(?i)(?:version|isbn|serial|order|invoice|sha|hash|commit|checksum|digest|uuid|ref\b|build|doi)"
CONTEXT = 24
VOTERS = ("format", "gazetteer", "context", "boundary")
#: kinds x loose or not x three votes of four labelers x three sizes x separators or none
MOST_PATTERNS = 5 * 2 * 3**4 * 3 * 2
BLOCK = 256
ERRS = 0.1


def prefix_sums(values: Column) -> Column:
    """Sums of what comes before each element; blocks first, so work is near linear."""
    n = F.size(values)
    blocks = F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))
    block = lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK))
    running = lambda xs, start: F.aggregate(xs, F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out")), lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]
    zero = F.lit(0).cast("bigint")
    sums = F.transform(blocks, lambda b: F.aggregate(block(b), zero, lambda a, x: a + x))
    starts = running(sums, zero)
    return F.when(n > 0, F.flatten(F.zip_with(blocks, starts, lambda b, s: running(block(b), s)))).otherwise(F.array().cast("array<bigint>"))


def digits_of(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Every second digit from the right doubled, 9 taken from what exceeds it; the sum ends in 0."""
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + worth(i)) % 10 == 0


def valid(kind: str, x: Column) -> Column:
    n = F.length(digits_of(x))
    return {
        "email": F.lit(True),
        "ip": x.rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$"),
        "card": F.when(n.between(12, 19), luhn(digits_of(x))).otherwise(False),
        "phone": n.between(9, 15),
        "secret": F.lit(True),
    }[kind]


def _spans(kind: str, loose: bool, matches: Column, pieces: Column) -> Column:
    """Structs of kind, offsets and what the labelers look at."""
    lengths = lambda xs: F.transform(xs, lambda x: F.length(x).cast("bigint"))
    steps = F.zip_with(lengths(matches), F.slice(lengths(pieces), F.lit(1), F.size(matches)), lambda a, b: a + b)
    starts = F.zip_with(prefix_sums(steps), lengths(F.slice(pieces, F.lit(1), F.size(matches))), lambda a, b: a + b)
    made = F.zip_with(F.arrays_zip(matches.alias("m"), starts.alias("s")), F.arrays_zip(F.slice(pieces, F.lit(1), F.size(matches)).alias("b"), F.slice(pieces, F.lit(2), F.size(matches)).alias("a")), lambda x, y: F.struct(x["m"].alias("m"), x["s"].alias("s"), F.right(y["b"], F.lit(CONTEXT)).alias("before"), F.left(y["a"], F.lit(1)).alias("after")))

    def span(x: Column) -> Column:
        m, before, after = x["m"], x["before"], x["after"]
        ok, n = valid(kind, m), F.length(digits_of(m))
        if loose:
            mixed = m.rlike("[A-Za-z]") & (n * 8 >= F.length(m))
            form = {"email": F.lit(0), "ip": F.lit(1), "card": F.when(luhn(digits_of(m)), 1).otherwise(-1), "phone": F.when(digits_of(m).rlike("^[01]"), -1).otherwise(0), "secret": F.when(mixed, 1).otherwise(-1)}[kind]
        else:
            form = F.when(ok, 1).otherwise(-1)
        plain = F.regexp_replace(m, r"(?i) ?[\[({] ?dot ?[\])}] ?", ".") if kind == "email" else m
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            x["s"].alias("start"),
            (x["s"] + F.length(m)).alias("end"),
            (F.lit(True) if loose else ~ok).alias("loose"),
            form.cast("int").alias("format"),
            F.when(plain.rlike(GAZETTEER[kind]), 1).otherwise(-1).alias("gazetteer"),
            F.when(before.rlike(FOR[kind]), 1).when(before.rlike(AGAINST_SECRET if kind == "secret" else AGAINST), -1).otherwise(0).alias("context"),
            F.when(F.right(before, F.lit(1)).rlike(r"[A-Za-z0-9]") | after.rlike(r"[A-Za-z0-9]"), -1).otherwise(0).alias("boundary"),
            F.when(n < 8, 0).when(n < 12, 1).otherwise(2).alias("digits"),
            F.when(m.rlike(r"[\x20()-]"), 1).otherwise(0).alias("parted"),
        )

    if kind == "card" and not loose:  # a few digits are no proposal of a card
        made = F.filter(made, lambda x: F.length(digits_of(x["m"])).between(12, 19))
    return F.transform(made, span)


def candidates(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, spans): base spans, and proposals that overlap no other span of their kind."""
    rows = df.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text"))
    for group, patterns in (("b", BASE), ("l", LOOSE)):
        for k, p in patterns.items():
            found = F.regexp_extract_all("text", F.lit(p), F.lit(0))
            if group == "b" and k in NEEDS:
                found = F.when(F.contains("text", F.lit(NEEDS[k])), found)
            elif group == "l" and k == "ip":
                found = F.when(F.contains("text", F.lit(":")), found)
            elif group == "l" and k == "email":
                found = F.when(F.col("text").rlike(r"[\[({] ?(?:at|AT) ?[\])}]"), found)
            rows = rows.withColumn(f"{group}_{k}", F.coalesce(found, F.array().cast("array<string>")))
    for group, patterns in (("b", BASE), ("l", LOOSE)):
        for k, p in patterns.items():
            rows = rows.withColumn(f"{group}p_{k}", F.when(F.size(f"{group}_{k}") > 0, F.split("text", p, -1)))
    kinds = []
    for k in KINDS:
        none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint,loose:boolean,format:int,gazetteer:int,context:int,boundary:int,digits:int,parted:int>>")
        parts = [F.when(F.col(f"{g}p_{k}").isNotNull(), _spans(k, g == "l", F.col(f"{g}_{k}"), F.col(f"{g}p_{k}"))).otherwise(none) for g, patterns in (("b", BASE), ("l", LOOSE)) if k in patterns]
        rows = rows.withColumn(f"both_{k}", F.array_sort(F.concat(*parts), lambda x, y: F.when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1).when(x["loose"], 1).otherwise(-1)))
        kinds.append(_without_touching(F.col(f"both_{k}")))
    return rows.select("doc_id", F.concat(*kinds).alias("spans"))


def _without_touching(spans: Column) -> Column:
    """Loose spans go that overlap the span before or after them, in order of start."""

    def keeps(x: Column, i: Column) -> Column:
        before, after = F.get(spans, i - 1), F.get(spans, i + 1)
        return ~x["loose"] | (F.coalesce(before["end"] <= x["start"], F.lit(True)) & F.coalesce(after["start"] >= x["end"], F.lit(True)))

    return F.when(F.exists(spans, lambda x: x["loose"]), F.filter(spans, keeps)).otherwise(spans)


def estimate_reliabilities(counts: dict[tuple, float], rounds: int = 40) -> dict[tuple, float]:
    """counts: {(kind, votes): spans}. Posterior of each pattern, by expectation-maximisation.

    Each kind has a share of true spans, and each labeler of that kind the
    chances of its three votes on true and on false spans. Every vote counts as
    seen once before, but a format's check that errs only ``ERRS`` times: two
    patterns that differ in one vote would leave open which is the true one.
    """
    posterior = {k: 1 / (1 + math.exp(1 - 2 * k[1][0] - sum(k[1][1:]))) for k in counts}  # to begin with: the votes' sum, the format's twice
    for _ in range(rounds):
        share, chance = {}, {}
        before = lambda y, i, v: ERRS if i == 0 and v == 1 - 2 * y else 1.0
        for (kind, votes), n in counts.items():
            for y, p in ((1, posterior[kind, votes]), (0, 1 - posterior[kind, votes])):
                share[kind, y] = share.get((kind, y), 1.0) + n * p
                for i, v in enumerate(votes):
                    chance[kind, y, i, v] = chance.get((kind, y, i, v), before(y, i, v)) + n * p
        for kind, votes in counts:
            both = []
            for y in (0, 1):
                both.append(math.log(share[kind, y]) + sum(math.log(chance[kind, y, i, v] / (share[kind, y] + 2)) for i, v in enumerate(votes)))
            posterior[kind, votes] = 1 / (1 + math.exp(max(-50, min(50, both[0] - both[1]))))
    return posterior


def features(kind: int, loose: bool, votes: tuple[int, ...], digits: int, parted: int) -> list[str]:
    return [f"kind={kind}", f"loose={int(loose)}", f"digits={digits}", f"parted={parted}", *(f"{name}={v}" for name, v in zip(VOTERS, votes, strict=True))]


def train_classifier(counts: dict[tuple, float], posterior: dict[tuple, float], rounds: int = 150, step: float = 1.0) -> dict[str, float]:
    """counts: {(kind, loose, votes, digits, parted): spans}. Weights of a logistic model fitted to the posteriors."""
    total, w = sum(counts.values()) or 1.0, {}
    rows = [(features(*k), n / total, posterior[k[0], k[2]]) for k, n in sorted(counts.items())]
    for _ in range(rounds):
        slope: dict[str, float] = {}
        for names, n, target in rows:
            p = 1 / (1 + math.exp(-max(-50.0, min(50.0, sum(w.get(x, 0.0) for x in names)))))
            for x in names:
                slope[x] = slope.get(x, 0.0) + n * (target - p)
        for x, d in slope.items():
            w[x] = w.get(x, 0.0) + step * d - 1e-4 * w.get(x, 0.0)
    return w


def _score(x: Column, w: dict[str, float]) -> Column:
    total = F.lit(0.0)
    for name, values in (("kind", range(len(KINDS))), ("digits", range(3)), ("parted", range(2)), *((v, (-1, 0, 1)) for v in VOTERS)):
        for v in values:
            if weight := w.get(f"{name}={v}"):
                total = total + F.when(x[name] == v, F.lit(weight)).otherwise(0.0)
    return total + F.when(x["loose"], F.lit(w.get("loose=1", 0.0))).otherwise(F.lit(w.get("loose=0", 0.0)))


def find_personal_data(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, spans) with spans of (kind, start, end, loose, score), base ones and those the classifier adds."""
    found = written(candidates(df, id_column, text_column), "pii")
    spans = found.where(F.size("spans") > 0).select(F.explode("spans").alias("x")).select("x.*")
    groups = spans.groupBy("kind", "loose", *VOTERS, "digits", "parted").count().limit(MOST_PATTERNS).collect()
    counts = {(r.kind, r.loose, tuple(r[v] for v in VOTERS), r.digits, r.parted): float(r["count"]) for r in groups}
    votes: dict[tuple, float] = {}
    for (kind, _, v, _, _), n in counts.items():
        votes[kind, v] = votes.get((kind, v), 0.0) + n
    w = train_classifier(counts, estimate_reliabilities(votes)) if counts else {}
    scored = F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["loose"].alias("loose"), _score(x, w).alias("score")))
    return found.select("doc_id", F.filter(scored, lambda x: ~x["loose"] | (x["score"] >= 0)).alias("spans"))


def digest_spans(found: DataFrame) -> DataFrame:
    """The query's columns: base counts, the digest of the base spans and all spans as text."""
    names = F.array(*[F.lit(k) for k in KINDS])
    told = lambda xs: F.array_join(F.transform(F.array_sort(xs), lambda x: F.concat(F.element_at(names, x["kind"] + 1), F.lit(":"), x["start"], F.lit(":"), x["end"])), ",")
    base = F.filter("spans", lambda x: ~x["loose"])
    of = lambda i: F.size(F.filter("spans", lambda x: ~x["loose"] & (x["kind"] == i))).cast("long")
    return found.select("doc_id", *[of(KINDS.index(k)).alias(f"n_{k}") for k in BASE], F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
