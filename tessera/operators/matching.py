"""Fuzzy name matching: best token-sort-ratio partner per left row.

token_sort_ratio(a, b) = 100 * 2 * LCS(sa, sb) / (|sa| + |sb|) where sa, sb are
the white-space tokens sorted and re-joined (case-sensitive).

The LCS length comes from built-in functions: a bit-parallel recurrence over
one 64-bit number per row of the table (Hyyro, 2004) where one side has at most
62 characters, else the plain dynamic program.

Pairs are found in three steps, each for the left keys that the one before has not settled:

1. equal keys (score 100);
2. keys one, then two insertions or deletions apart: both sides emit what is left of them, in order, without
   some letters, and meet on equal remainders, so only pairs that are this close meet, not all keys with the
   same digits.  Every other right key is s = 2 (then 3) or more steps away, which bounds its score by
   2 l / (2 l + s) for a left key of l characters: a better partner is final and leaves the open keys;
3. the rest by letter counts: distinct multisets meet by compatible length (and a salt that splits crowded
   lengths), and only those whose common letters allow a score of at least the cut-off, or of what step 2
   has found, are opened into keys.

A score of at least t bounds the lengths, 2 min(l1, l2) / (l1 + l2) >= t, and the common characters,
2 |A n B| / (l1 + l2) >= t as multisets.  Scores are evaluated where a pair meets, and a partial maximum
per left key is all that is shuffled: pairs are never written out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import shared_dir

# Fixed values of the reference matching rules.
SCORE_CUTOFF = 70.0
AUTO_VERIFY = 95.0

# White space of a Unicode split, which is more than the ASCII class.
_SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
_BITS = 62  # characters of a side whose table row fits a 64-bit number


def token_sort_key(c) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    toks = F.filter(F.split(F.coalesce(col, F.lit("")), _SPACE), lambda x: x != "")
    return F.array_join(F.array_sort(toks), " ")


def _chars(key: Column) -> Column:
    return F.regexp_extract_all(key, F.lit("(?s)."), F.lit(0))


def _masks(chars: Column) -> Column:
    """Character -> the bits of its places; null for more than ``_BITS`` characters."""
    places = F.transform(chars, lambda c, i: F.struct(c.alias("c"), F.pow(F.lit(2.0), i).cast("bigint").alias("bit")))
    letters = F.array_distinct(chars)
    bits = F.transform(letters, lambda c: F.aggregate(
        places, F.lit(0).cast("bigint"), lambda m, p: F.when(p["c"] == c, m.bitwiseOR(p["bit"])).otherwise(m)))
    return F.when(F.size(chars) <= _BITS, F.map_from_arrays(letters, bits))


def _lcs_bits(masks: Column, size: Column, other: Column) -> Column:
    """LCS length of the side that ``masks`` and ``size`` describe and the characters ``other``."""
    full = F.pow(F.lit(2.0), size).cast("bigint") - 1

    def step(s, c):
        u = s["v"].bitwiseAND(F.coalesce(F.try_element_at(s["m"], c), F.lit(0).cast("bigint")))
        return F.struct((s["v"] + u).bitwiseOR(s["v"] - u).bitwiseAND(s["f"]).alias("v"), s["m"].alias("m"), s["f"].alias("f"))

    start = F.struct(full.alias("v"), masks.alias("m"), full.alias("f"))
    return size - F.aggregate(other, start, step, lambda s: F.bit_count(s["v"]))


def _lcs_table(a: Column, b: Column) -> Column:
    def row(prev, ch):
        return F.aggregate(F.sequence(F.lit(1), F.size(b)), F.array(F.lit(0)), lambda cur, j: F.concat(cur, F.array(
            F.when(F.element_at(b, j) == ch, F.element_at(prev, j) + 1)
            .otherwise(F.greatest(F.element_at(prev, j + 1), F.element_at(cur, -1))))))
    return F.element_at(F.aggregate(a, F.array_repeat(F.lit(0), F.size(b) + 1), row), -1)


def _bound(value: Column, f) -> Column:
    """f(value) with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def key_ratio(a: Column, b: Column) -> Column:
    """Ratio of two token-sort keys; two empty keys are equal."""
    def of(p):
        ca, cb = p["a"], p["b"]
        la, lb = F.size(ca), F.size(cb)
        lcs = (F.when((la == 0) | (lb == 0), 0)
               .when(la <= _BITS, _bound(_masks(ca), lambda m: _lcs_bits(m, la, cb)))
               .when(lb <= _BITS, _bound(_masks(cb), lambda m: _lcs_bits(m, lb, ca))).otherwise(_lcs_table(ca, cb)))
        return F.when(la + lb == 0, 100.0).otherwise(200.0 * lcs / (la + lb))
    return _bound(F.struct(_chars(a).alias("a"), _chars(b).alias("b")), of)


def token_sort_ratio(a, b) -> Column:
    return key_ratio(token_sort_key(a), token_sort_key(b))


def ratio(a: str, b: str) -> float:
    """Plain reference of ``key_ratio`` for tests."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(a) + len(b)) if a or b else 100.0


def _common(masks: Column, key: Column) -> Column:
    """Characters that the multisets of ``key`` and of the side of ``masks`` share."""
    count = lambda c: F.length(key) - F.length(F.replace(key, c, F.lit("")))
    return F.aggregate(F.map_entries(masks), F.lit(0), lambda n, e: n + F.least(F.bit_count(e["value"]), count(e["key"])))


def _remainders(key: Column, most: int) -> Column:
    """(n, rest, gone): the letters of a key without any n <= ``most`` (0 to 2) of them; ``rest`` is hashed."""
    def of(letters):
        n = F.size(letters)
        first = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i < n) & (
            (i == 0) | (F.get(letters, i) != F.get(letters, i - 1))))

        def without(i, j):
            rest = F.filter(letters, lambda c, p: (p != i) & (p != j))
            gone = F.array_compact(F.array(F.when(i >= 0, F.get(letters, i)), F.when((j >= 0) & (j != i), F.get(letters, j))))
            return F.struct(F.size(gone).alias("n"), F.xxhash64(F.array_join(rest, "")).alias("rest"), gone.alias("gone"))
        out = [F.array(without(F.lit(-1), F.lit(-1)))]
        if most >= 1:
            out.append(F.transform(first, lambda i: without(i, i)))
        if most >= 2:  # a second letter after the first one, or the next copy of the same
            out.append(F.flatten(F.transform(first, lambda i: F.transform(F.filter(
                F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda j: (j > i) & (j < n) & (
                    F.array_contains(first, j) | ((j == i + 1) & (F.get(letters, i) == F.get(letters, j))))),
                lambda j: without(i, j)))))
        return F.concat(*out)
    return _bound(F.array_sort(_chars(key)), of)


def near_pairs(names: DataFrame, partners: DataFrame, by: list[str]) -> DataFrame:
    """Pairs of keys whose letters, in any order, are at most ``NEAR`` insertions and deletions apart.

    Keys with the same digits all meet, so the matching takes ``step_pairs``."""
    left = names.select("__k", *by, F.explode(_remainders(F.col("__k"), NEAR)).alias("__v"))
    left = left.select("__k", *by, F.col("__v.gone").alias("__lg"), F.col("__v.rest").alias("__rest"),
                       F.explode(F.sequence(F.lit(0), NEAR - F.col("__v.n"))).alias("__n"))
    right = partners.select("__rk", "__r", *by, F.explode(_remainders(F.col("__rk"), NEAR)).alias("__v"))
    right = right.select("__rk", "__r", *by, F.col("__v.gone").alias("__rg"), F.col("__v.rest").alias("__rest"), F.col("__v.n").alias("__n"))
    met = left.join(right, ["__rest", "__n", *by])
    return met.filter(~F.arrays_overlap("__lg", "__rg") | (F.size("__lg") == 0) | (F.size("__rg") == 0))


def _without(key: Column, n: int) -> Column:
    """Hashes of what is left of a key, in its order, without any ``n`` (0 to 2) of its letters."""
    size = F.length(key)
    cut = lambda text, i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text)))
    places = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    if n == 0:
        out = F.array(F.xxhash64(key))
    elif n == 1:
        out = F.transform(places(F.lit(1), size), lambda i: F.xxhash64(cut(key, i)))
    else:  # the later letter goes first, so the place of the other one stays
        out = F.flatten(F.transform(places(F.lit(2), size), lambda j: F.transform(
            places(F.lit(1), j - 1), lambda i: F.xxhash64(cut(cut(key, j), i)))))
    return F.array_distinct(out)


NEAR = 2  # insertions and deletions that step 2 covers


def step_pairs(names: DataFrame, partners: DataFrame, by: list[str], steps: int) -> DataFrame:
    """Pairs of unequal keys that are ``steps`` insertions and deletions apart (or fewer by an even number).

    Keys are that close exactly if n letters of the one and ``steps`` - n of the other can go so that the same is
    left.  Partners of a length that no key can reach are left out before their letters are.
    """
    reach = names.select(F.explode(F.sequence(F.length("__k") - steps, F.length("__k") + steps)).alias("__len")).distinct()
    partners = partners.withColumn("__len", F.length("__rk")).join(reach, "__len", "left_semi").drop("__len")

    def rests(df, key, order):
        each = F.flatten(F.array(*[F.transform(_without(F.col(key), n), lambda h: F.struct(
            F.lit(order(n)).alias("n"), h.alias("rest"))) for n in range(steps + 1)]))  # noqa: B023
        return df.select("*", F.explode(each).alias("__v")).select(
            *df.columns, F.col("__v.n").alias("__n"), F.col("__v.rest").alias("__rest"))
    left = rests(names.select("__k", *by), "__k", lambda n: n)
    right = rests(partners.select("__rk", "__r", *by), "__rk", lambda n: steps - n)
    return left.join(right, ["__rest", "__n", *by])


def far_pairs(names: DataFrame, partners: DataFrame, by: list[str], t: float, salts: int) -> DataFrame:
    """Pairs of keys whose lengths and common letters allow a score of ``__floor`` (a share, at least ``t``)."""
    letters = lambda c: F.array_join(F.array_sort(_chars(F.col(c))), "")
    left, right = names.withColumn("__lv", letters("__k")), partners.withColumn("__rv", letters("__rk"))
    size = F.length("__lv")
    lengths = F.sequence(F.ceil(size * (t / (2 - t)) - 1e-9).cast("int"), F.floor(size * ((2 - t) / t) + 1e-9).cast("int"))
    lv = left.groupBy("__lv", *by).agg(F.min("__floor").alias("__low")).select(
        "*", F.explode(lengths).alias("__len")).select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__salt"))
    rv = right.select("__rv", *by).distinct().select(
        "__rv", *by, _masks(_chars(F.col("__rv"))).alias("__m"), F.length("__rv").alias("__len"),
        F.pmod(F.hash("__rv"), F.lit(salts)).alias("__salt"))
    enough = F.col("__m").isNull() | (2 * _common(F.col("__m"), F.col("__lv")) >= F.col("__low") * (size + F.col("__len")) - 1e-9)
    alike = lv.join(rv, ["__len", "__salt", *by]).filter(enough).select("__lv", "__rv", *by)
    return alike.join(left, ["__lv", *by]).join(right, ["__rv", *by])


def _best(pairs: DataFrame, by: list[str], right_id: str, cutoff: float) -> DataFrame:
    """Per left key the best partner (ties: the smaller right id) with at least the cut-off."""
    scored = pairs.select("__k", *by, "__r", key_ratio(F.col("__k"), F.col("__rk")).alias("__score"))
    return scored.filter(F.col("__score") >= cutoff).groupBy("__k", *by).agg(F.max_by(
        F.struct("__r", "__score"), F.struct(F.col("__score"), -F.col(f"__r.{right_id}"))).alias("__b"))


def fuzzy_best_match(left: DataFrame, right: DataFrame, left_id: str = "fpl_id", left_name: str = "fpl_name",
                     right_id: str = "understat_id", right_name: str = "understat_name",
                     cutoff: float = SCORE_CUTOFF, right_cols: tuple = (), block: str | None = None,
                     salts: int = 4) -> DataFrame:
    """Per left row the best right row by token-sort ratio >= cutoff (ties: smaller right id).

    Unmatched left rows are kept with NULL right columns, score 0 and note NO_MATCH; blank
    names match blank names.  ``block`` names a column of both sides that must be equal (a team,
    a season).
    """
    shared_dir(left.sparkSession)
    by = [block] if block else []
    names = left.select(token_sort_key(left_name).alias("__k"), *by).distinct()
    partners = (right.select(token_sort_key(right_name).alias("__rk"), *by, F.struct(
        F.col(right_id), F.col(right_name), *[F.col(c) for c in right_cols]).alias("__r"))
        .groupBy("__rk", *by).agg(F.min_by("__r", f"__r.{right_id}").alias("__r"))).checkpoint(eager=True)
    same = names.join(partners.withColumnRenamed("__rk", "__k"), ["__k", *by]).select(
        "__k", *by, F.struct("__r", F.lit(100.0).alias("__score")).alias("__b"))
    open_ = names.join(same.select("__k", *by), ["__k", *by], "left_anti").checkpoint(eager=True)
    size, points = F.length("__k"), F.col("__b.__score")
    settled, rest = [], open_.select("*", F.lit(None).cast(same.schema["__b"].dataType).alias("__b"))
    for steps in range(1, NEAR + 1):
        # one row a left key, in the shared folder: the pairs behind it are met once
        near = _best(step_pairs(rest, partners, by, steps), by, right_id, cutoff).withColumnRenamed("__b", "__now")
        near = rest.join(near, ["__k", *by], "left").select("__k", *by, F.when(
            F.coalesce(F.col("__now.__score"), F.lit(-1.0)) > F.coalesce(points, F.lit(-1.0)), F.col("__now"))
            .otherwise(F.col("__b")).alias("__b")).checkpoint(eager=True)
        final = F.coalesce(points > 200.0 * size / (2 * size + steps + 1) + 1e-9, F.lit(False))
        settled.append(near.filter(final))
        rest = near.filter(~final)
    rest = rest.select("__k", *by, "__b", (F.greatest(points, F.lit(cutoff)) / 100).alias("__floor"))
    far = _best(far_pairs(rest, partners, by, cutoff / 100.0, salts), by, right_id, cutoff)
    best = same.unionByName(far)
    for part in settled:
        best = best.unionByName(part)
    best = best.select(F.col("__k").alias("__bk"), *[F.col(c).alias(f"__b_{c}") for c in by], "__b")
    on = token_sort_key(left_name) == F.col("__bk")
    for c in by:
        on = on & (F.col(c) == F.col(f"__b_{c}"))
    out = left.join(best, on, "left")
    found, points = F.col("__b.__r"), F.col("__b.__score")
    return out.select(
        *left.columns, found[right_id].alias(right_id), found[right_name].alias(right_name),
        *[found[c].alias(c) for c in right_cols],
        F.bround(F.coalesce(points, F.lit(0.0)), 1).alias("match_score"),  # half to even
        F.coalesce(points >= AUTO_VERIFY, F.lit(False)).alias("verified"),
        F.when(points.isNull(), F.lit("NO_MATCH")).otherwise(F.lit("")).alias("notes"))
