"""Text columns: normalisation steps, slugs, codes, trigrams and edit similarities, as built-in expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Characters that separate words.
SEPARATORS = r"[-‐‑‒–—_./\\'\"`‘’“”,]+"


def unify_separators(c: Column) -> Column:
    return F.regexp_replace(c, SEPARATORS, " ")


def strip_punctuation(c: Column) -> Column:
    """Deletes what is neither letter, number nor white space."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}\s]", "")


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(c: Column) -> Column:
    """Spark has no NFKC of its own, so texts cross to Python for this step alone."""
    return _nfkc(c)


def unicode_form(c: Column) -> Column:
    """NFKC in lower case."""
    return F.lower(nfkc(c))


def normalise(c: Column) -> Column:
    """Lower case, separators, punctuation and spaces; unicode_form comes before where text may hold other forms."""
    return collapse_spaces(strip_punctuation(unify_separators(F.lower(c))))


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda t: t != "")


def split_letters_digits(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(\p{L})(\p{Nd})", "$1 $2"), r"(\p{Nd})(\p{L})", "$1 $2")


def repair_lookalikes(words: Column) -> Column:
    """Words of digits and l get 1 for l; words of letters and 0 get o for 0."""
    digits = lambda w: w.rlike("^[0-9l]*l[0-9l]*$")
    letters = lambda w: w.rlike("^[a-z0]*0[a-z0]*$")
    return F.transform(words, lambda w: F.when(digits(w), F.translate(w, "l", "1")).when(letters(w), F.translate(w, "0", "o")).otherwise(w))


def literal_map(m: Mapping[str, Sequence[str] | str]) -> Column:
    pairs = [x for k, v in m.items() for x in (F.lit(k), F.lit(v) if isinstance(v, str) else F.array(*map(F.lit, v)))]
    return F.create_map(*pairs)


def expand_synonyms(words: Column, synonyms: Mapping[str, Sequence[str]]) -> Column:
    table = literal_map(synonyms)
    return F.flatten(F.transform(words, lambda w: F.coalesce(table[w], F.array(w))))


def expand_compounds(c: Column, synonyms: Mapping[str, Sequence[str]]) -> Column:
    """Synonyms of the words that hold both letters and digits, before those are split."""
    table = literal_map(synonyms)
    mixed = lambda w: w.rlike(r"\p{L}") & w.rlike(r"\p{N}")
    return F.array_join(F.flatten(F.transform(tokens(c), lambda w: F.coalesce(F.when(mixed(w), table[w]), F.array(w)))), " ")


def extract_attributes(words: Column, patterns: Mapping[str, Sequence[str]]) -> Column:
    """struct(storage, network, dual_sim, color, year, rest) of words, from left to right: two words at once, then one.

    patterns: words of storage, network, dual_sim and color, in that order of precedence; spaces and hyphens in them don't
    count. The last hit of a kind stays, and words that hit leave.
    """
    sets = {k: sorted({"".join(x.lower().replace("-", " ").split()) for x in patterns.get(k, [])}) for k in ("storage", "network", "dual_sim", "color")}
    kind = lambda key: F.coalesce(*[F.when(key.isin(*v), k) for k, v in sets.items() if v], F.lit(None).cast("string"))
    none = F.lit(None).cast("string")
    start = F.struct(F.lit(0).alias("skip"), *[none.alias(k) for k in (*sets, "year")], F.array().cast("array<string>").alias("rest"))

    def kinds(w: Column, i: Column) -> Column:
        """What a word alone is, and what it is with the one after it."""
        both = F.lower(F.concat(w, F.get(words, i + 1)))
        return F.struct(w.alias("word"), F.lower(w).alias("one"), both.alias("two"), F.coalesce(kind(F.lower(w)), F.when(F.lower(w).rlike("^20[0-9]{2}$"), "year")).alias("own"), kind(both).alias("wide"))

    def step(s: Column, x: Column) -> Column:
        free = s["skip"] == 0
        hit, value = F.coalesce(x["wide"], x["own"]), F.when(x["wide"].isNotNull(), x["two"]).otherwise(x["one"])
        taken = {k: F.when(free & (hit == k), value).otherwise(s[k]).alias(k) for k in (*sets, "year")}
        skip = F.when(~free, s["skip"] - 1).when(x["wide"].isNotNull(), 1).otherwise(0)
        rest = F.when(free & hit.isNull(), F.concat(s["rest"], F.array(x["word"]))).otherwise(s["rest"])
        return F.struct(skip.cast("int").alias("skip"), *taken.values(), rest.alias("rest"))

    finish = lambda s: F.struct(s["storage"].alias("storage"), s["network"].alias("network"), s["dual_sim"].isNotNull().alias("dual_sim"), s["color"].alias("color"), s["year"].cast("int").alias("year"), s["rest"].alias("rest"))
    return F.aggregate(F.transform(words, kinds), start, step, finish)


def single_edit(a: Column, b: Column) -> Column:
    """Whether one insertion, deletion, substitution or swap of neighbours makes b of a, both of three characters or more."""
    return (F.length(a) >= 3) & (F.length(b) >= 3) & (F.abs(F.length(a) - F.length(b)) <= 1) & (osa_distance(a, b) == 1)


def split_codes(c: Column, pattern: Column | None = None) -> Column:
    """Codes between | or ;, trimmed; only those of the pattern, where there is one."""
    codes = F.filter(F.transform(F.split(c, "[|;]"), lambda x: F.trim(x)), lambda x: x != "")
    return codes if pattern is None else F.when(pattern.isNull(), codes).otherwise(F.filter(codes, lambda x: F.regexp_like(x, pattern)))


def yes_no(c: Column) -> Column:
    """The words for yes and no."""
    said = F.lower(F.trim(c))
    return F.coalesce(literal_map({"да": "yes", "нет": "no", "true": "yes", "false": "no", "1": "yes", "0": "no"})[said], said)


def repair_keyboard(words: Column, source: str, target: str, known: Sequence[str]) -> Column:
    """Words typed in another layout, where the key-by-key reading is a known word."""
    return F.transform(words, lambda w: F.when(F.translate(w, source, target).isin(*known), F.translate(w, source, target)).otherwise(w))


def transliterate(c: Column, table: Mapping[str, str]) -> Column:
    """Per code point: single characters at once, longer replacements one after the other."""
    single = {k: v for k, v in table.items() if len(v) == 1}
    out = F.translate(c, "".join(single), "".join(single.values())) if single else c
    for k, v in table.items():
        if len(v) != 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    return out


def padded(c: Column) -> Column:
    """The lower-case text with two spaces on each side, whose parts of three characters are its trigrams."""
    return F.concat(F.lit("  "), F.lower(c), F.lit("  "))


def trigrams(c: Column) -> Column:
    """Trigrams of the lower-case text with two spaces on each side, repeated ones too."""
    # The text is padded once, as the value of an outer lambda, not once a trigram.
    return F.transform(F.array(padded(c)), lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substr(p, i, F.lit(3))))[0]


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def osa_distance(a: Column, b: Column) -> Column:
    """Edits of one character, or a swap of two neighbours, none twice at the same place."""
    x, y = F.split(a, ""), F.split(b, "")
    n, m = F.length(a), F.length(b)
    first = F.sequence(F.lit(0), m)

    def row(state: Column, i: Column) -> Column:
        before, last = state["last"], state["now"]

        def cell(done: Column, j: Column) -> Column:
            same = F.get(x, i - 1) == F.get(y, j - 1)
            best = F.least(F.get(last, j) + 1, F.get(done, j - 1) + 1, F.get(last, j - 1) + F.when(same, 0).otherwise(1))
            swap = (i > 1) & (j > 1) & (F.get(x, i - 1) == F.get(y, j - 2)) & (F.get(x, i - 2) == F.get(y, j - 1))
            return F.concat(done, F.array(F.when(swap, F.least(best, F.get(before, j - 2) + 1)).otherwise(best)))

        now = F.aggregate(F.when(m > 0, F.sequence(F.lit(1), m)).otherwise(F.array().cast("array<int>")), F.array(i), cell)
        return F.struct(last.alias("last"), now.alias("now"))

    steps = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    done = F.aggregate(steps, F.struct(first.alias("last"), first.alias("now")), row)
    return F.get(done["now"], m)


def edit_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - osa_distance(a, b) / longest)


def jaro(a: Column, b: Column) -> Column:
    """Greedy matches within the window; half the transpositions are not rounded."""
    n, m = F.length(a), F.length(b)
    x, y = F.split(a, ""), F.split(b, "")
    window = F.greatest(F.floor(F.greatest(n, m) / 2) - 1, F.lit(0)).cast("int")

    def step(used: Column, i: Column) -> Column:
        lo, hi = F.greatest(F.lit(1), i - window), F.least(m, i + window)
        places = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
        hit = F.get(F.filter(places, lambda j: (F.get(y, j - 1) == F.get(x, i - 1)) & ~F.array_contains(used, j)), F.lit(0))
        return F.concat(used, F.array(F.coalesce(hit, F.lit(0))))

    picked = F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), F.array().cast("array<int>"), step)
    mine = F.filter(F.transform(picked, lambda j, i: F.when(j > 0, F.get(x, i))), lambda c: c.isNotNull())
    theirs = F.transform(F.array_sort(F.filter(picked, lambda j: j > 0)), lambda j: F.get(y, j - 1))
    k = F.size(mine)
    moved = F.size(F.filter(F.zip_with(mine, theirs, lambda p, q: p != q), lambda d: d))
    return F.when((n == 0) & (m == 0), F.lit(1.0)).when(k == 0, F.lit(0.0)).otherwise((k / n + k / m + (k - moved / 2) / k) / 3)


def jaro_winkler(a: Column, b: Column) -> Column:
    prefix = F.lit(0)
    for i in range(4, 0, -1):
        prefix = F.when((F.length(a) >= i) & (F.length(b) >= i) & (F.left(a, F.lit(i)) == F.left(b, F.lit(i))), F.greatest(prefix, F.lit(i))).otherwise(prefix)
    j = jaro(a, b)
    return j + prefix * 0.1 * (1 - j)


def screen_key(width: Column, height: Column, dpr: Column) -> Column:
    number = F.regexp_replace(F.regexp_replace(F.format_string("%.3f", dpr.cast("double")), "0+$", ""), "[.]$", "")
    return F.concat(F.least(width, height).cast("string"), F.lit("x"), F.greatest(width, height).cast("string"), F.lit("@"), number)


def device_slug(name: Column, insignificant: Sequence[str]) -> Column:
    """Significant words of a name joined by hyphens; remarks on two SIM cards go first."""
    plain = normalise(F.regexp_replace(name, r"(?i)\(?\s*dual[\s-]*sim\s*\)?", " "))
    return F.array_join(F.filter(tokens(plain), lambda w: ~w.isin(*insignificant)), "-")


def parse_conditions(c: Column) -> Column:
    """scope, value and support for each value of `scope:a/b,c=answer;...`; parts of another form or scope are left out."""
    form = r"^\s*([A-Za-z_]+)\s*:\s*([^=]*?)\s*=\s*(\S+)\s*$"
    said = literal_map({"yes": "supported", "да": "supported", "no": "not_supported", "нет": "not_supported", "supported": "supported", "not_supported": "not_supported"})

    def rows(part: Column) -> Column:
        scope, support = F.regexp_extract(part, form, 1), said[F.lower(F.regexp_extract(part, form, 3))]
        named = F.when(scope == "region", "region").when(scope.isin("osVersion", "os_version"), "osVersion")
        values = F.split(F.regexp_extract(part, form, 2), "[/,]")
        return F.filter(F.transform(values, lambda v: F.struct(named.alias("scope"), F.trim(v).alias("value"), support.alias("support"))), lambda r: r["scope"].isNotNull() & r["support"].isNotNull() & (r["value"] != ""))

    return F.flatten(F.transform(F.split(c, ";"), rows))
