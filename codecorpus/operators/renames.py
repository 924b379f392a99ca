"""Parsing, consolidating and applying rename suggestions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexical as lx
from ..functions import renames as rn
from ..functions.classify import guard_reserved, has_bad_escape
from ..functions.text import exact_mean, let
from .rows import explode_once

# Names under which an answer may hold its list and its fields, by preference.
LIST_FIELDS = ("suggestions", "renames", "variablesAndFunctionsToRename")
OLD_FIELDS = ("name", "originalName", "from")
NEW_FIELDS = ("newName", "suggestedName", "to")
REASON_FIELDS = ("reasoning", "reason")
TYPES = ("variable", "function", "class", "method", "property")
NUMBER = "^(BIGINT|DECIMAL|DOUBLE|FLOAT)"
# What the error rows of answers, their items and rename rows say.
NO_JSON = "No JSON found in response"
NO_LIST = "Response does not contain a suggestions array"
BAD_ITEM = "Invalid suggestion at index "
BAD_OLD_NAME = "Invalid originalName: expected non-empty string"
BAD_NEW_NAME = "Invalid suggestedName: expected non-empty string"
NO_CODE = "Code must be a string"
NO_NAMES = "Each rename operation must have name and newName strings"


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _answer(payload: Column) -> Column:
    """The JSON of an answer: the whole text, else the part from the first bracket or brace,
    whichever comes first, to the last one of its sort. Text that starts with a bracket or
    a brace can only parse to a list or an object."""
    whole = F.when(payload.rlike(r"^[ \t\n\r]*[\[{]"), F.try_parse_json(payload))
    arr = F.try_parse_json(F.regexp_extract(payload, r"(?s)\[.*\]", 0))
    obj = F.try_parse_json(F.regexp_extract(payload, r"(?s)\{.*\}", 0))
    a, o = F.instr(payload, "["), F.instr(payload, "{")
    list_first = (a > 0) & ((o == 0) | (a < o))
    return F.coalesce(whole, F.when(list_first, arr), obj)


def _items(answer: Column) -> Column:
    """The list of an answer as array<variant>, null when it has none."""
    places = ("$",) + tuple(f"$.{f}" for f in LIST_FIELDS)
    return F.coalesce(*[F.try_variant_get(answer, p, "array<variant>") for p in places])


def _usable(kind: Column, text: Column) -> Column:
    """Whether a field counts: present and neither empty, zero, false nor null."""
    zero = kind.rlike(NUMBER) & (text.try_cast("double") == 0)
    return ~(
        (kind == "VOID") | ((kind == "STRING") & (text == ""))
        | ((kind == "BOOLEAN") & (text == "false")) | F.coalesce(zero, F.lit(False))
    )


def _first_usable(fields: tuple[str, ...], value: str) -> Column:
    """`value` (kind or text) of the first field that counts."""
    return F.coalesce(*[
        F.when(_usable(F.col(f"{f}_kind"), F.col(f"{f}_text")), F.col(f"{f}_{value}"))
        for f in fields
    ])


def _listed(responses: DataFrame) -> DataFrame:
    """Answers with their list; parsing and searching are separate projections, so that a
    text is parsed once however often its parts are used."""
    answers = responses.select("*", _answer(F.col("payload")).alias("answer"))
    return answers.select(
        "*", F.col("answer").isNull().alias("no_json"), _items(F.col("answer")).alias("items"))


def _checked_items(rows: DataFrame, *more: str) -> DataFrame:
    """Suggestions from rows of (request_id, ordinal, item, no_list, no_json, more…)."""
    keep = ["request_id", "ordinal", "no_list", "no_json", *more]
    names = OLD_FIELDS + NEW_FIELDS + REASON_FIELDS + ("type", "confidence")
    shape = f"struct<{','.join(f'{f}:variant' for f in names)}>"
    fields = rows.select(*keep, F.try_variant_get("item", "$", shape).alias("f"))
    texts = fields.select(
        *keep, F.col("f").isNotNull().alias("is_object"),
        *[_kind(F.col(f"f.{f}")).alias(f"{f}_kind") for f in names],
        *[F.try_variant_get(F.col(f"f.{f}"), "$", "string").alias(f"{f}_text")
          for f in names if f != "confidence"],
        F.try_variant_get("f.confidence", "$", "double").alias("confidence"),
    )
    chosen = texts.select(
        *keep, "is_object", "confidence", "confidence_kind", "type_kind",
        F.lower("type_text").alias("type"),
        *[_first_usable(fs, v).alias(f"{n}_{v}")
          for n, fs in (("old", OLD_FIELDS), ("new", NEW_FIELDS), ("reason", REASON_FIELDS))
          for v in ("kind", "text")],
    )

    def is_text(name: str) -> Column:
        return F.coalesce(F.col(f"{name}_kind") == "STRING", F.lit(False))

    error = (
        F.when(F.col("no_json"), NO_JSON)
        .when(F.col("no_list"), NO_LIST)
        .when(~F.col("is_object"),
              F.concat(F.lit(BAD_ITEM), F.col("ordinal").cast("string")))
        .when(~is_text("old"), BAD_OLD_NAME)
        .when(~is_text("new"), BAD_NEW_NAME)
        .when(F.col("reason_kind").isNotNull() & ~is_text("reason"),
              "Invalid reasoning: expected text")
    )
    in_range = F.col("confidence_kind").rlike(NUMBER) & F.col("confidence").between(0.0, 1.0)
    known = (F.col("type_kind") == "STRING") & F.col("type").isin(*TYPES)
    checked = chosen.withColumn("error", error)
    ok = F.col("error").isNull()
    return checked.select(
        "request_id", "ordinal", *more,
        F.when(ok, F.col("old_text")).alias("original_name"),
        F.when(ok, F.col("new_text")).alias("suggested_name"),
        F.when(ok, F.when(in_range, F.col("confidence")).otherwise(rn.DEFAULT_CONFIDENCE))
        .alias("confidence"),
        F.when(ok, F.coalesce("reason_text", F.lit(""))).alias("reasoning"),
        F.when(ok, F.when(known, F.col("type")).otherwise("variable")).alias("type"),
        "error",
    )


def parse_suggestions(responses: DataFrame) -> DataFrame:
    """Rename suggestions in answers (request_id, payload); one row per list item.

    A row with `error` set stands for an item, or a whole answer (ordinal null), that cannot
    be used. One bad item never costs the other items of its answer.
    """
    rows = _listed(responses.select("request_id", "payload")).select(
        "request_id", "no_json", F.col("items").isNull().alias("no_list"),
        F.posexplode_outer("items").alias("ordinal", "item"),
    ).filter(F.col("no_list") | F.col("ordinal").isNotNull())
    return _checked_items(rows.withColumn("ordinal", F.col("ordinal").cast("long")))


def parse_text_fallback(responses: DataFrame) -> DataFrame:
    """Renames named in free text, at the default confidence."""
    rows = explode_once(
        responses, "request_id", array=rn.text_fallback(F.col("payload")), name="r",
        position="ordinal")
    return rows.select(
        "request_id", "ordinal", "r.original_name", "r.suggested_name",
        F.lit(rn.DEFAULT_CONFIDENCE).alias("confidence"),
        F.lit(rn.FALLBACK_REASON).alias("reasoning"),
        F.lit("variable").alias("type"),
    )


def parse_with_fallback(responses: DataFrame) -> DataFrame:
    """Suggestions from JSON answers, and from the text of answers without usable JSON.

    Each answer is parsed once and read once: all sorts of rows come out of one explode. Items
    that cannot be used are rows with `error` set, and so is an answer (ordinal null) with
    neither a list nor a rename in its text.
    """
    pair = "struct<original_name:string,suggested_name:string>"
    listed = _listed(responses.select("request_id", "payload"))
    from_json = F.transform("items", lambda v: F.struct(
        v.alias("item"), F.lit(None).cast(pair).alias("pair")))
    from_text = F.transform(rn.text_fallback(F.col("payload")), lambda p: F.struct(
        F.lit(None).cast("variant").alias("item"), p.alias("pair")))
    nothing = F.array(F.struct(
        F.lit(None).cast("variant").alias("item"), F.lit(None).cast(pair).alias("pair")))
    rows = explode_once(
        listed, "request_id", "no_json", name="r", position="ordinal",
        array=F.when(F.col("items").isNotNull(), from_json).otherwise(
            let(from_text, lambda t: F.when(F.size(t) > 0, t).otherwise(nothing))),
    ).select("request_id", "no_json", "ordinal", "r.item", "r.pair")
    no_list = F.col("item").isNull() & F.col("pair").isNull()
    checked = _checked_items(rows.withColumns({
        "no_list": no_list, "ordinal": F.when(~no_list, F.col("ordinal"))}), "pair")
    found = F.col("pair").isNotNull()

    def either(text_value: Column, name: str) -> Column:
        return F.when(found, text_value).otherwise(F.col(name)).alias(name)

    return checked.select(
        "request_id", "ordinal",
        either(F.col("pair.original_name"), "original_name"),
        either(F.col("pair.suggested_name"), "suggested_name"),
        either(F.lit(rn.DEFAULT_CONFIDENCE), "confidence"),
        either(F.lit(rn.FALLBACK_REASON), "reasoning"),
        either(F.lit("variable"), "type"),
        F.when(~found, F.col("error")).alias("error"),
    )


def repair_json(responses: DataFrame) -> DataFrame:
    return responses.withColumn("payload", rn.repair_trailing_comma(F.col("payload")))


def pair_parallel_arrays(responses: DataFrame) -> DataFrame:
    """Rows from answers that list renames; an item may hold two names or two parallel arrays."""
    items = F.try_variant_get(F.try_parse_json("payload"), "$", "array<variant>")

    def listed(item: Column, path: str) -> Column:
        one = F.try_variant_get(item, path, "string")
        return F.coalesce(F.try_variant_get(item, path, "array<string>"), F.when(one.isNotNull(), F.array(one)))

    found = F.transform(items, lambda v: rn.pair_up(listed(v, "$.name"), listed(v, "$.newName")))
    pairs = explode_once(
        responses, "request_id", name="p", position="ordinal",
        array=F.flatten(F.filter(found, lambda p: p.isNotNull())))
    return pairs.select("request_id", "ordinal", "p.name", "p.new_name")


def best_suggestions(suggestions: DataFrame) -> DataFrame:
    """The most confident suggestion per unit and name; the earliest one wins a tie.

    A maximum, not a ranked window: it is combined before the shuffle, so a name or a unit
    with a large part of all suggestions sends one row per task.
    """
    order = F.struct(
        F.col("confidence").alias("confidence"),
        (-F.col("chunk_index")).alias("c"), (-F.col("ordinal")).alias("o"),
        "suggested_name", "reasoning", "type",
    )
    best = suggestions.groupBy("unit_id", "original_name").agg(F.max(order).alias("b"))
    return best.select(
        "unit_id", "original_name", "b.suggested_name", "b.confidence", "b.reasoning", "b.type",
        (-F.col("b.c")).alias("chunk_index"), (-F.col("b.o")).alias("ordinal"),
    )


def overall_confidence(
    suggestions: DataFrame, key: str = "unit_id", all_keys: DataFrame | None = None
) -> DataFrame:
    """Mean confidence per key, 0 for keys of `all_keys` without suggestions."""
    means = suggestions.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(exact_mean(F.col("confidence")), F.lit(0.0)).alias("confidence"),
    )
    if all_keys is None:
        return means
    return all_keys.select(key).join(means, key, "left").fillna(0, ["n", "confidence"])


def quality_warnings(
    suggestions: DataFrame, threshold: float = rn.DEFAULT_THRESHOLD, key: str = "unit_id"
) -> DataFrame:
    """Excluded suggestions and the mean of the kept ones, with warnings, in one pass."""
    kept = F.col("confidence") >= threshold
    stats = suggestions.groupBy(key).agg(
        F.count(F.lit(1)).alias("offered"),
        F.count_if(kept).alias("applied"),
        F.coalesce(exact_mean(F.when(kept, F.col("confidence"))), F.lit(0.0)).alias("mean"),
    )
    return stats.withColumn(
        "warnings",
        rn.quality_warnings(F.col("offered") - F.col("applied"), F.col("mean"), threshold),
    )


def split_malformed(renames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable rename rows, error rows) of (unit_id, original_name, suggested_name)."""
    reason = (
        F.when(F.col("unit_id").isNull(), NO_CODE)
        .when(F.col("original_name").isNull() | (F.col("original_name") == "")
              | F.col("suggested_name").isNull() | (F.col("suggested_name") == ""),
              NO_NAMES)
    )
    checked = renames.withColumn("reason", reason)
    return (
        checked.filter(F.col("reason").isNull()).drop("reason"),
        checked.filter(F.col("reason").isNotNull()),
    )


def _dealt(units: DataFrame) -> DataFrame:
    """Units by (unit_id, text_key), which tells texts of one unit_id apart. The number of parts is
    fixed because reading a text costs far more than its bytes suggest."""
    parts = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return units.select("unit_id", "code", F.xxhash64("code").alias("text_key")).repartition(parts, "unit_id", "text_key")


def _found(dealt: DataFrame, renames: DataFrame, runs: Callable[[Column], Column] = lx.runs) -> DataFrame:
    """(unit_id, text_key, found): the runs of each text that have a rename, and what replaces them.

    Each different run of a text meets renames once, by (unit, name), so that a unit is spread over
    all tasks and the rows shuffled do not grow with how often a name is used.
    """
    names = explode_once(dealt, "unit_id", "text_key", name="name", array=F.array_distinct(runs(F.col("code"))))
    return names.join(renames.select("unit_id", F.col("original_name").alias("name"), F.col("suggested_name").alias("new")),
                      ["unit_id", "name"]).groupBy("unit_id", "text_key").agg(
        F.sort_array(F.collect_set(F.struct("name", "new"))).alias("found"))


def _with_found(units: DataFrame, renames: DataFrame) -> DataFrame:
    """(unit_id, code, found): each unit with its names that have a rename, null without any. Texts are
    dealt out once; what is found, no longer than the text, is put next to it."""
    dealt = _dealt(units)
    return dealt.join(_found(dealt, renames), ["unit_id", "text_key"], "left").drop("text_key")


def _rewritten(rows: DataFrame, chosen: Callable[[Column, Column], Column]) -> DataFrame:
    """(unit_id, code) with the chosen hits replaced; a text without hits is kept as it is."""
    code = F.col("code")
    new = let(lx.tokens(code), lambda t: let(lx.placed(t, F.col("found")), lambda hits: F.when(
        F.size(hits) == 0, code).otherwise(let(chosen(t, hits), lambda c: lx.replaced(t, c)))))
    return rows.select("unit_id", F.when(F.col("found").isNull(), code).otherwise(new).alias("code"))


def apply_by_token(units: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Apply the best suggestion of each name at once, to free names only.

    Lexical: strings, comments and template words are kept, properties, object keys and method
    definitions are skipped, scopes and regular-expression literals are not told apart.
    """
    return _rewritten(_with_found(units, best_suggestions(suggestions)), lx.free_hits)


def apply_everywhere(units: DataFrame, renames: DataFrame) -> DataFrame:
    """Rename every identifier occurrence; the last of several renames of a name wins.

    `renames` has unit_id, ordinal, original_name, suggested_name. A reserved target gets a
    trailing ``$``.
    """
    last = renames.groupBy("unit_id", "original_name").agg(
        F.max_by("suggested_name", "ordinal").alias("suggested_name")
    ).withColumn("suggested_name", guard_reserved(F.col("suggested_name")))
    return _rewritten(_with_found(units, last), lambda toks, hits: hits)


def _may_match(units: DataFrame, renames: DataFrame) -> DataFrame:
    """Renames that can find something: the first word of the original occurs in the text of
    the unit or in a target that another rename may write. Joined by (unit, word), so that
    a unit is spread over all tasks; originals without any word are kept."""
    runs = r"\w+"
    written = explode_once(
        renames, "unit_id", name="word",
        array=F.regexp_extract_all("suggested_name", F.lit(runs), F.lit(0)))
    in_text = explode_once(
        units, "unit_id", name="word",
        array=F.array_distinct(F.regexp_extract_all("code", F.lit(runs), F.lit(0))))
    keyed = renames.withColumn("word", F.regexp_extract("original_name", runs, 0))
    found = keyed.filter(F.col("word") != "").join(
        in_text.unionByName(written).distinct(), ["unit_id", "word"], "left_semi")
    return found.unionByName(keyed.filter(F.col("word") == "").select(*found.columns)).drop("word")


WORD, ESCAPED = r"^\w+\z", r"\\\w"


def _words(code: Column, pattern: str = r"\w+|\W+") -> Column:
    return F.regexp_extract_all(code, F.lit(pattern), F.lit(0))


def _composed(ordered: Column) -> Column:
    """What each of the renames of a unit comes to when those behind it in the order follow.

    Only a rename whose target is another one's original is followed, and only through such.
    """
    names = F.transform(ordered, lambda r: r["original_name"])
    met = F.array_intersect(F.transform(ordered, lambda r: r["suggested_name"]), names)

    def followed(on: Column) -> Column:
        placed = F.transform(ordered, lambda r, k: F.struct(
            r["original_name"].alias("original_name"), r["suggested_name"].alias("suggested_name"), k.alias("k")))
        links = F.filter(placed, lambda r: F.array_contains(on, r["original_name"]))
        return let(links, lambda ls: F.transform(placed, lambda r: F.struct(
            r["original_name"].alias("original_name"),
            F.when(F.array_contains(on, r["suggested_name"]), F.aggregate(
                F.filter(ls, lambda x: x["k"] > r["k"]), r["suggested_name"],
                lambda t, x: F.when(t == x["original_name"], x["suggested_name"]).otherwise(t))
            ).otherwise(r["suggested_name"]).alias("suggested_name"))))

    plain = F.transform(ordered, lambda r: F.struct(
        r["original_name"].alias("original_name"), r["suggested_name"].alias("suggested_name")))
    return let(met, lambda on: F.when(F.size(on) == 0, plain).otherwise(followed(on)))


def apply_in_sequence(units: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Apply one rename after the other, longest original first.

    Renames may chain here: a later one also hits names that an earlier one wrote. Where all
    names of a unit are single words and its text has no escape before a word, what a word becomes
    depends on the word alone: the chain is composed first and the text is read once, each word
    meeting its rename by (unit, word). Other units go through their renames one by one, each name
    that can be found once.
    """
    best = best_suggestions(suggestions).filter(F.length("original_name") > 1)
    dealt = _dealt(units)
    lists = _may_match(dealt, best).groupBy("unit_id").agg(
        F.collect_list(F.struct("original_name", "suggested_name")).alias("l"))
    lists = lists.select("unit_id", rn.longest_first(F.col("l")).alias("l"), F.exists(
        "l", lambda r: ~(r["original_name"].rlike(WORD) & r["suggested_name"].rlike(WORD))).alias("odd"))
    composed = explode_once(lists.filter(~F.col("odd")), "unit_id", array=_composed(F.col("l")), name="r").select("unit_id", "r.*")
    # what a text needs meets it in one join by (unit_id, text_key), the way texts are dealt
    needed = dealt.select("unit_id", "text_key").distinct().join(lists, "unit_id").join(
        _found(dealt, composed, lambda c: _words(c, r"\w+")), ["unit_id", "text_key"], "left")
    rows = dealt.join(needed, ["unit_id", "text_key"], "left")
    at_once = let(_words(F.col("code")), lambda t: lx.replaced(t, lx.placed(t, F.col("found"))))
    code = F.when(F.col("l").isNull(), F.col("code")).when(
        F.col("odd") | F.col("code").rlike(ESCAPED), rn.apply_in_sequence(F.col("code"), F.col("l"))).when(
        F.col("found").isNull(), F.col("code")).otherwise(at_once)
    return rows.select("unit_id", code.alias("code"))


def rename_hits(units: DataFrame, suggestions: DataFrame) -> DataFrame:
    """How often applying them changes each suggested name in its unit, zero included."""
    best = best_suggestions(suggestions).select("unit_id", "original_name", "suggested_name")
    rows = _with_found(units, best).filter("found is not null")
    changed = explode_once(rows, "unit_id", name="h", array=let(lx.tokens(F.col("code")), lambda t: let(
        lx.placed(t, F.col("found")), lambda hits: lx.free_hits(t, hits)))).groupBy(
        "unit_id", F.col("h.name").alias("original_name")).agg(F.count(F.lit(1)).alias("n"))
    return best.join(changed, ["unit_id", "original_name"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0))
    )


def rename_totals(hits: DataFrame) -> DataFrame:
    """Offered and applied renames and changed occurrences per unit."""
    return hits.groupBy("unit_id").agg(
        F.count(F.lit(1)).alias("offered"),
        F.count_if(F.col("n") > 0).alias("applied"),
        F.sum("n").cast("long").alias("occurrences"),
    )


def guard_targets(suggestions: DataFrame) -> DataFrame:
    return suggestions.withColumn("suggested_name", guard_reserved(F.col("suggested_name")))


def flag_bad_escapes(units: DataFrame) -> DataFrame:
    return units.select("unit_id", has_bad_escape(F.col("code")).alias("bad_escape"))
