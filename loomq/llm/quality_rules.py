"""Quality rules by weak supervision, in DataFrame functions only.

Seven rules each vote good (+1), bad (-1) or abstain (0) on a document; every one can vote both ways. A document is good or
bad, and rules vote independently given which: the model holds, for each rule and class, how often it votes what, and the
share of good documents. Expectation-maximisation over the counts of vote patterns fits it, from a start that treats both
classes alike and trusts each rule a little, with as little in pseudo-counts. A document is kept if, given its votes, it is
good with at least even probability, and if it does not fail the base rule; so a rule that is often wrong is outvoted.
Documents that fail the base rule are not fitted, as the posterior is not asked about them: they would be most of the bad.
There are at most 3**7 patterns, whatever the input, and one row of 43 numbers comes to the driver.

Defined cases: null text is empty text: no words, and base failed. A document's text counts whole, however long. Rows are
judged one by one, so repeated rows get equal verdicts; an empty table gives no rows, and a table without a row that passes
the base rule is judged by the start. Other columns are ignored, whatever their names; filtered() keeps them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _shared

#: Measures of a document, as columns that features() gives.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_term_lines", "n_letters", "n_upper", "n_exclaim")

#: Rules: name, when it votes bad, when it votes good (bad goes first; else it abstains). SQL over MEASURES, integers only.
RULES = (
    ("symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    ("dup_lines", "10 * n_dup_lines > 3 * n_lines", "10 * n_dup_lines <= n_lines AND n_lines > 0"),
    ("repeats", "100 * n_repeat_words > 20 * n_words", "100 * n_repeat_words <= 5 * n_words AND n_words > 2"),
    ("upper", "10 * n_upper > 2 * n_letters", "10 * n_upper <= n_letters AND n_letters > 0"),
    ("exclaim", "10 * n_exclaim > n_words", "50 * n_exclaim <= n_words"),
    ("letters", "100 * n_letters < 75 * word_chars", "100 * n_letters >= 90 * word_chars AND n_letters > 0"),
    ("line_ends", "2 * n_term_lines < n_lines", "10 * n_term_lines >= 9 * n_lines AND n_lines > 0"),
)
STEPS, FIRST_PRIOR = 40, 0.5
#: How often a rule votes what its document is, abstains, and votes the other: at the start, and as pseudo-counts, which bind no large table.
FIRST, PSEUDO = (0.6, 0.3, 0.1), (1.5, 1.2, 1.0)
MIN_WORDS, MAX_REPEATS = 50, 50


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once however often body names it."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more. Sorting finds equal neighbours: n log n, no map."""
    window = lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    starts = F.sequence(F.lit(0), F.size(words) - 3)
    structs = F.sort_array(F.transform(starts, lambda i: F.struct(window(i).alias("w"), i.alias("i"))))

    def equal_neighbours(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k)["w"] == x["w"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        gaps = F.zip_with(F.slice(p, F.lit(2), F.size(p) - 1), F.slice(p, F.lit(1), F.size(p) - 1), lambda b, a: F.least(F.lit(3), b - a))
        return F.when(F.size(p) > 0, F.aggregate(gaps, F.lit(3), lambda t, g: t + g)).otherwise(0)

    return _let(_let(structs, equal_neighbours), covered)


def features(docs: DataFrame, *also: str) -> DataFrame:
    """doc_id and MEASURES (long) of every row of docs (doc_id, text); the columns `also` come along."""
    x = docs.select(*also, docs["doc_id"].cast("long").alias("doc_id"), _shared.text_or_empty(docs).alias("t"))
    x = x.select(*also, "doc_id", "t", F.array_remove(F.split("t", _shared.SPACE_CLASS + "+"), "").alias("w"), F.split("t", "\n").alias("lines"))
    hashes = F.when(F.size("w") > 3, F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))))
    full = F.filter("lines", lambda s: s.rlike(_shared.WORD))
    x = x.select(*also, "doc_id", "t", "w", full.alias("lines"), hashes.alias("h"), F.length(F.array_join("w", "")).alias("word_chars"))
    # documents without two windows of one hash have no two equal ones; only the others are sorted
    repeats = F.when(F.size(F.array_distinct("h")) < F.size("h"), _repeated(F.col("w"))).otherwise(0)
    without = lambda pattern: F.length(F.regexp_replace("t", pattern, ""))
    measures = {
        "n_words": F.size("w"), "word_chars": F.col("word_chars"), "n_symbols": F.length("t") - without(r"[#*$%&|<>]+"), "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")), "n_repeat_words": repeats,
        "n_lines": F.size("lines"), "n_term_lines": F.size(F.filter("lines", lambda s: s.rlike(r"""[.!?"'”»…]\s*$"""))), "n_letters": without(r"[^\p{L}\s]+") - (F.length("t") - F.col("word_chars")),
        "n_upper": F.length("t") - without(r"\p{Lu}+"), "n_exclaim": F.length("t") - F.length(F.replace(F.col("t"), F.lit("!"), F.lit(""))),
    }
    return x.select(*also, "doc_id", *[measures[m].cast("long").alias(m) for m in MEASURES])


def votes() -> Column:
    """The rules' votes over MEASURES, as array<int>."""
    return F.array(*[F.expr(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END") for _, bad, good in RULES])


def logit(p: float) -> float:
    return math.log(p / (1 - p))


@dataclass(frozen=True)
class Model:
    """prior: share of good documents; bad, good: of each rule, how often it votes -1, 0 and 1 on documents of that class."""

    prior: float
    bad: tuple[tuple[float, float, float], ...]
    good: tuple[tuple[float, float, float], ...]

    def posterior(self, vote: Column) -> Column:
        """The probability that a document with these votes is good."""
        odds = F.lit(logit(self.prior))
        for j, (bad, good) in enumerate(zip(self.bad, self.good, strict=True)):
            log = [math.log(g / b) for b, g in zip(bad, good, strict=True)]
            odds += F.when(vote[j] == -1, log[0]).when(vote[j] == 0, log[1]).otherwise(log[2])
        return 1 / (1 + F.exp(-odds))


def em_sql(patterns: str, rules: int, steps: int = STEPS) -> str:
    """A Spark SQL expression over `patterns`, array<struct<v array<int>, n bigint>>: struct<pi double, bad array<array<double>>, good ...>."""
    total = lambda what: f"aggregate(transform(ps, p -> {what}), 0D, (s, x) -> s + x)"
    odds = f"aggregate(sequence(0, {rules - 1}), ln(m.pi / (1D - m.pi)), (s, j) -> s + ln(m.good[j][p.v[j] + 1] / m.bad[j][p.v[j] + 1]))"

    def tables(share: str, pseudo: tuple[float, ...]) -> str:
        """Of each rule, the shares of its votes among documents that count `share`."""
        hit = total(f"CASE WHEN p.v[j] = w - 1 THEN p.n * {share} ELSE 0D END")
        return f"transform(sequence(0, {rules - 1}), j -> transform(sequence(0, 2), w -> (array({', '.join(f'{x}D' for x in pseudo)})[w] + {hit}) / ({sum(pseudo)}D + {total(f'p.n * {share}')})))"

    prior = f"(1D + {total('p.n * p.q')}) / (2D + {total('double(p.n)')})"
    step = f"transform(array(transform({patterns}, p -> named_struct('v', p.v, 'n', p.n, 'q', 1D / (1D + exp(-({odds})))))), ps -> named_struct('pi', {prior}, 'bad', {tables('(1D - p.q)', PSEUDO)}, 'good', {tables('p.q', PSEUDO[::-1])}))[0]"
    first = lambda x: f"array_repeat(array({', '.join(f'{y}D' for y in x)}), {rules})"
    return f"aggregate(sequence(1, {steps}), named_struct('pi', {FIRST_PRIOR}D, 'bad', {first(FIRST)}, 'good', {first(FIRST[::-1])}), (m, i) -> {step})"


def fit(measured: DataFrame) -> Model:
    """The model of the rows with MEASURES that pass the base rule. Without any, the model that the rounds begin with."""
    patterns = measured.where(~base_failed()).groupBy(votes().alias("v")).agg(F.count(F.lit(1)).alias("n"))
    held = patterns.agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("ps"))
    row = held.where(F.size("ps") > 0).select(F.expr(em_sql("ps", len(RULES))).alias("m")).first()
    if row is None:
        return Model(FIRST_PRIOR, (FIRST,) * len(RULES), (FIRST[::-1],) * len(RULES))
    return Model(row.m.pi, tuple(map(tuple, row.m.bad)), tuple(map(tuple, row.m.good)))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATS * F.col("n_words"))


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, MEASURES, base_failed, posterior and kept of every row of docs."""
    measured = _shared.written(features(docs), "features")
    posterior = fit(measured).posterior(votes())
    return measured.withColumn("base_failed", base_failed()).withColumn("posterior", posterior).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))


def filtered(docs: DataFrame) -> DataFrame:
    """The rows of docs that judged() keeps, with the columns of docs.

    Each row's measures are written beside its own columns, so nothing is joined and doc_id need not be a key.
    """
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), docs["doc_id"], docs["text"])
    measured = _shared.written(features(row, "_row"), "features")
    return measured.where(~base_failed() & (fit(measured).posterior(votes()) >= 0.5)).select("_row.*")


def oracle(documents: str = "documents") -> str:
    """DuckDB SQL for doc_id, the contract's columns and kept: EM as a recursive query over one row."""
    k = len(RULES)
    vote = "[" + ", ".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END" for _, bad, good in RULES) + "]"
    posterior = lambda m, v: f"1 / (1 + exp(-(ln({m}pi / (1 - {m}pi)) + list_sum([ln({m}good[j][{v}[j] + 2] / {m}bad[j][{v}[j] + 2]) for j in range(1, {k + 1})]))))"
    first = lambda x: f"[{list(x)}::DOUBLE[] for j in range({k})]"

    def tables(share: str, pseudo: tuple[float, ...]) -> str:
        one = lambda w: f"({pseudo[w]}::DOUBLE + list_sum([CASE WHEN p.v[j] = {w - 1} THEN p.n * {share} ELSE 0 END for p in ps])) / ({sum(pseudo)}::DOUBLE + list_sum([p.n * {share} for p in ps]))"
        return f"[[{', '.join(map(one, range(3)))}] for j in range(1, {k + 1})]"

    return f"""
        WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM {documents}),
        w AS (SELECT r, [x for x in regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+') if x <> ''] AS w, [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS l FROM d),
        g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM w, unnest(range(1, len(w) - 1)) u(i)),
        twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
        rep AS (SELECT r, count(DISTINCT i + o) AS n FROM twice, range(3) k(o) GROUP BY r),
        f AS (SELECT d.r, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
              length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
              coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines, len([x for x in l if regexp_matches(x, '[.!?"''”»…]\\s*$')]) AS n_term_lines,
              length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) AS n_letters, length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclaim
              FROM d JOIN w USING (r) LEFT JOIN rep USING (r)),
        v AS (SELECT *, {vote} AS v, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATS} * n_words AS base_failed FROM f),
        pats AS (SELECT list({{'v': v, 'n': n}} ORDER BY v) AS ps FROM (SELECT v, count(*) AS n FROM v WHERE NOT base_failed GROUP BY v)),
        em AS (SELECT 0 AS i, {FIRST_PRIOR}::DOUBLE AS pi, {first(FIRST)} AS bad, {first(FIRST[::-1])} AS good
               UNION ALL SELECT i + 1, (1 + list_sum([p.n * p.q for p in ps])) / (2 + list_sum([p.n for p in ps])), {tables("(1 - p.q)", PSEUDO)}, {tables("p.q", PSEUDO[::-1])}
               FROM (SELECT i, [{{'v': p.v, 'n': p.n::DOUBLE, 'q': {posterior("", "p.v")}}} for p in pats.ps] AS ps FROM em, pats WHERE i < {STEPS} AND pats.ps IS NOT NULL)),
        m AS (SELECT * FROM em ORDER BY i DESC LIMIT 1),
        b AS (SELECT v.*, {posterior("m.", "v.v")} AS posterior FROM v, m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND posterior >= 0.5 AS kept FROM b"""
