"""Plans as JSON documents: migrated, filled with defaults, their items coerced by a catalog and cleaned, and written back as JSON.

A document is taken apart once: its items become rows, a catalog of kinds and parameters is joined to them, and what is left is collected by plan in the order it had.
Values travel as JSON text, so fields that no rule names pass through. Nothing raises: a document that isn't a JSON object counts as an empty one,
a bad item goes and is told of with a reason. Normalising twice changes nothing more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.maths import normal_color
from .clocks import number

#: For each track the prefix of its ids, the field that names an item's kind, and whether items have a time (at) instead of a range.
TRACKS = {
    "text": ("tx", "preset", False), "graphics": ("gr", "kind", False), "cutaways": ("cw", "kind", False),
    "effects": ("fx", "kind", False), "transitions": ("tr", "kind", True), "sfx": ("sf", "name", True),
}
VERSION, SHORTEST, TEXT_PRESET, LONGEST_STOP = 2, 0.05, "title_pop", 10.0
#: Sections whose missing fields the defaults fill.
SECTIONS = ["entities", "director", "fx.captions", "fx.music", "fx.grade"]
#: default is JSON text; opts are the values of a select; size is the length of a point, else null; listed asks for a list.
CATALOG = "track string, kind string, param string, type string, low double, high double, step double, opts array<string>, size int, listed boolean, nullable boolean, required boolean, default string"
#: A catalog is broadcast up to so many kinds.
SMALL = 10_000
NONE = "null"


def let(x: Column, f) -> Column:
    """f of x, with x worked out once however often f names it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def json_text(value: Column) -> Column:
    """A variant as JSON text that stays the same when it is parsed and written again (a double like 1e5 is 100000.0 the first time).

    to_json and parse_json make a JSON factory for every string and every call, which took most of the time; a string is therefore quoted here, and plain takes the quotes off.
    """
    again = lambda t: F.when(t.rlike("\\.0(?![0-9])"), F.coalesce(F.to_json(parsed(t)), t)).otherwise(t)
    return F.when(F.schema_of_variant(value) == "STRING", quoted(F.try_variant_get(value, "$", "string"))).otherwise(let(F.coalesce(F.to_json(value), F.lit(NONE)), again))


def members(value: Column, path: str = "$", but: tuple[str, ...] = ()) -> Column:
    """The fields of an object in a variant, but for some, as JSON text by name; null where there is no object."""
    got = F.try_variant_get(value, path, "map<string,variant>")
    return F.transform_values(F.map_filter(got, lambda k, _: ~k.isin(*but)) if but else got, lambda _, x: json_text(x))


def fields(value: Column, path: str = "$", but: tuple[str, ...] = ()) -> Column:
    """members, empty where there is no object."""
    return F.coalesce(members(value, path, but), F.create_map().cast("map<string,string>"))


def field(value: Column, path: str) -> Column:
    """One field of a variant, as JSON text."""
    return json_text(F.try_variant_get(value, path, "variant"))


def parsed(json: Column) -> Column:
    return F.try_parse_json(F.coalesce(json, F.lit(NONE)))


def listed(value: Column, path: str = "$") -> Column:
    """The elements of an array in a variant, as JSON text; empty where there is no array."""
    return F.coalesce(F.transform(F.try_variant_get(value, path, "array<variant>"), json_text), F.array().cast("array<string>"))


def plain(json: Column) -> Column:
    """What a JSON scalar says, as text; null for null, the JSON itself for objects and arrays."""
    simple = json.rlike(r'(?s)^"[^\\]*"$')
    return F.when(simple, F.substring(json, F.lit(2), F.length(json) - 2)).otherwise(F.try_variant_get(parsed(json), "$", "string"))


def is_a(json: Column, first: str) -> Column:
    return F.coalesce(F.substring(json, 1, 1) == first, F.lit(False))


def finite(json: Column) -> Column:
    """A JSON number, or a string that is one, as a finite double; else null."""
    text = F.when(json.rlike("^[-0-9]"), json).when(is_a(json, '"'), plain(json))
    return let(text, lambda t: let(F.when(t.rlike("[0-9]") & ~t.rlike("[dDfF]\\s*$"), t.try_cast("double")), number))


def quoted(text: Column) -> Column:
    return let(text, lambda t: F.when(t.rlike(r'[\x00-\x1f"\\]'), F.btrim(F.to_json(F.array(t)), F.lit("[]"))).otherwise(F.concat(F.lit('"'), t, F.lit('"'))))


def written(x: Column) -> Column:
    """A number as JSON text, whole ones without a fraction."""
    return let(x, lambda n: F.when(n == 0, "0").otherwise(F.regexp_replace(n.cast("decimal(38,10)").cast("string"), "\\.?0+$", "")))


def colored(text: Column) -> Column:
    """normal_color, of a text whose # may be missing too."""
    return normal_color(F.concat(F.lit("#"), F.regexp_replace(F.trim(text), "^#", "")))


def truth(x: Column) -> Column:
    return F.when(x, "true").otherwise("false")


def as_object(by_name: Column) -> Column:
    """JSON text of an object, its fields in order of their names."""
    pairs = F.transform(F.sort_array(F.map_entries(by_name)), lambda e: F.concat(quoted(e["key"]), F.lit(":"), e["value"]))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def as_array(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def over(base: Column, more: Column) -> Column:
    """base with the fields of more put over it."""
    return let(more, lambda m: F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(m, k)), m))


def without(base: Column, *names: str) -> Column:
    return F.map_filter(base, lambda k, _: ~k.isin(*names))


def put(base: Column, **values: Column) -> Column:
    """base with fields set to JSON text; a null text takes the field out."""
    new = F.map_filter(F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v))), lambda _, v: v.isNotNull())
    return F.map_concat(without(base, *values), new)


def coerced(json: Column, rule: Column) -> Column:
    """A value as its rule wants it, by its type: num (clamped, whole on steps of 1; a point of size numbers), bool, color, select, text; the default otherwise."""
    return let(F.struct(json.alias("json"), finite(json).alias("x")), lambda v: _coerced(v["json"], v["x"], rule))


def _coerced(json: Column, x: Column, rule: Column) -> Column:
    # Each branch parses only what it needs.
    said, parts = plain(json), F.when(is_a(json, "["), listed(parsed(json))).otherwise(F.array().cast("array<string>"))
    default = F.coalesce(rule["default"], F.lit(NONE))
    held = lambda v: let(v, lambda n: F.when(n.isNotNull(), F.least(F.greatest(n, rule["low"]), rule["high"])))
    whole = (rule["step"] == 1) & (rule["low"] == F.floor(rule["low"]))
    num = F.when(x.isNull(), default).when(whole, written(F.bround(held(x)))).otherwise(written(held(x)))
    numbers = let(parts, lambda ps: F.transform(ps, finite))
    point = let(numbers, lambda ns: F.when((F.size(ns) == rule["size"]) & F.forall(ns, lambda n: n.isNotNull()), as_array(F.transform(ns, lambda n: written(held(n))))).otherwise(default))
    flag = F.when(json.isin("true", "false"), json).when(json.rlike("^[-0-9]"), truth(F.coalesce(x, F.lit(1.0)) != 0)).otherwise(F.when(default == "true", "true").otherwise("false"))
    color = lambda v: F.when(is_a(v, '"'), colored(plain(v)))
    one = F.coalesce(quoted(color(json)), F.when(F.coalesce(rule["nullable"], F.lit(False)), F.lit(NONE)).otherwise(default))
    colors = F.filter(F.transform(F.when(is_a(json, "["), parts).otherwise(F.array(json)), color), lambda c: c.isNotNull())
    pick = F.when(F.coalesce(is_a(json, '"') & F.array_contains(rule["opts"], said), F.lit(False)), json).otherwise(default)
    split = F.filter(F.transform(F.split(said, "[,\n]"), lambda s: F.trim(s)), lambda s: s != "")
    texts = F.when(is_a(json, '"'), split).when(is_a(json, "["), F.transform(parts, lambda p: F.coalesce(plain(p), F.lit("None")))).otherwise(F.array().cast("array<string>"))
    text = F.when(is_a(json, '"'), json).otherwise(quoted(said))
    kind, many = rule["type"], F.coalesce(rule["listed"], F.lit(False))
    return (
        F.when((kind == "num") & rule["size"].isNotNull(), point).when(kind == "num", num).when(kind == "bool", flag)
        .when((kind == "color") & many, as_array(F.transform(colors, quoted))).when(kind == "color", one).when(kind == "select", pick)
        .when((kind == "text") & many, as_array(F.transform(texts, quoted))).when(kind == "text", text).otherwise(json)
    )


def ruled(item: Column, rules: Column, fill: bool) -> Column:
    """item (JSON text by name) with every parameter of the rules coerced; one that is missing gets its default if it is required, or with fill."""

    def value(r: Column) -> Column:
        now = F.try_element_at(item, r["param"])
        given = lambda v: F.when((v == NONE) & ~F.coalesce(r["nullable"], F.lit(False)) & r["required"], F.coalesce(r["default"], v)).when(v == NONE, v).otherwise(coerced(v, r))
        return let(now, lambda v: F.when(v.isNotNull(), given(v)).when(r["required"] | F.lit(fill), r["default"]))

    new = F.transform(rules, lambda r: F.struct(r["param"].alias("key"), value(r).alias("value")))
    return over(item, F.map_from_entries(F.filter(new, lambda e: e["value"].isNotNull())))


def media(json: Column) -> Column:
    """A media descriptor with nothing but what is known of one, JSON text; null without a sid of letters, digits, _ and -."""
    return let(fields(parsed(json)), _media)


def _media(m: Column) -> Column:
    at = lambda k: F.try_element_at(m, F.lit(k))
    string = lambda k, n: F.when(is_a(at(k), '"'), quoted(F.substring(plain(at(k)), 1, n)))
    sid = F.trim(plain(at("sid")))
    length = lambda k: let(finite(at(k)), lambda n: F.when(n >= 0, written(F.bround(n))))
    crop = listed(parsed(at("crop")))
    box = F.when((F.size(crop) == 4) & F.forall(crop, lambda x: finite(x).isNotNull()), as_array(F.transform(crop, lambda x: written(F.greatest(F.lit(0.0), F.least(F.lit(1.0), finite(x)))))))
    kept = put(
        F.create_map().cast("map<string,string>"), sid=quoted(sid), type=F.when(at("type").isin('"image"', '"video"'), at("type")), name=string("name", 200), w=length("w"), h=length("h"),
        dur=F.when(finite(at("dur")) >= 0, written(F.round(finite(at("dur")), 4))), thumb=string("thumb", 300), crop=box,
    )
    return F.when(is_a(at("sid"), '"') & sid.rlike("^[A-Za-z0-9_-]{1,64}$"), as_object(kept))


def _rows(texts: Column, cleaned) -> Column:
    """The objects of a list as cleaned makes them (struct t, json; null drops one), in order of t and then of place."""
    made = F.transform(texts, lambda x, i: F.struct(cleaned(x).alias("x"), i.alias("i")))
    kept = F.transform(F.filter(made, lambda r: r["x"].isNotNull()), lambda r: F.struct(r["x"]["t"].alias("t"), r["i"].alias("i"), r["x"]["json"].alias("json")))
    return as_array(F.transform(F.array_sort(kept), lambda r: r["json"]))


def _bounded(x: Column, duration: Column) -> Column:
    x = F.greatest(F.lit(0.0), x)
    return F.when(duration.isNull(), x).otherwise(F.least(x, duration))


def _range(json: Column, duration: Column, name: str, more) -> Column:
    """A row with start and end cleaned and the field name as more makes it of its number; without either it goes."""

    def cleaned(m: Column) -> Column:
        at = lambda k: finite(F.try_element_at(m, F.lit(k)))
        return let(F.struct(at("start").alias("a"), at("end").alias("b"), more(at(name)).alias("x")), lambda v: bounded(m, v))

    def bounded(m: Column, v: Column) -> Column:
        low, high = _bounded(F.least(v["a"], v["b"]), duration), _bounded(F.greatest(v["a"], v["b"]), duration)
        known = v["a"].isNotNull() & v["b"].isNotNull() & v["x"].isNotNull()
        return let(F.struct(F.when(known, low).alias("low"), F.when(known, high).alias("high")), lambda r: done(m, v, r))

    def done(m: Column, v: Column, r: Column) -> Column:
        low = F.round(r["low"], 4)
        row = put(m, start=written(low), end=written(F.round(r["high"], 4)), **{name: written(v["x"])})
        return F.when(r["high"] - r["low"] >= SHORTEST, F.struct(low.alias("t"), as_object(row).alias("json")))

    return F.when(is_a(json, "{"), let(fields(parsed(json)), cleaned))


def caption_heights(texts: Column, duration: Column) -> Column:
    """Ranges in which captions sit at a height y (0.1 to 0.9), cleaned and in order: JSON text."""
    return _rows(texts, lambda x: _range(x, duration, "y", lambda y: F.when(y.isNotNull(), F.round(F.least(F.lit(0.9), F.greatest(F.lit(0.1), y)), 4))))


def swells(texts: Column, duration: Column) -> Column:
    return _rows(texts, lambda x: _range(x, duration, "db", lambda db: F.least(F.lit(12.0), F.greatest(F.lit(-24.0), F.coalesce(db, F.lit(3.0))))))


def stops(texts: Column, duration: Column) -> Column:
    """Silences: at inside the plan, a dur (if there is one) over 0 and at most 10 s, mode tape or cut."""

    def cleaned(m: Column) -> Column:
        at, dur, mode = (F.try_element_at(m, F.lit(k)) for k in ("at", "dur", "mode"))
        return let(F.struct(F.round(_bounded(finite(at), duration), 4).alias("t"), finite(at).isNotNull().alias("known"), finite(dur).alias("dur"), dur.alias("said"), mode.alias("mode")), lambda v: done(m, v))

    def done(m: Column, v: Column) -> Column:
        dur = F.when(v["dur"].isNull(), v["said"]).otherwise(written(F.round(F.least(v["dur"], F.lit(LONGEST_STOP)), 4)))
        row = put(m, at=written(v["t"]), dur=dur, mode=F.when(v["mode"].isin(NONE, '"tape"', '"cut"'), v["mode"]))
        return F.when(v["known"] & (v["dur"].isNull() | (v["dur"] > 0)), F.struct(v["t"].alias("t"), as_object(row).alias("json")))

    return _rows(texts, lambda x: F.when(is_a(x, "{"), let(fields(parsed(x)), cleaned)))


def _entries(plans: DataFrame, by: list[str], json: str, name: str, made) -> DataFrame:
    """by, track, i, duration and what made makes of the variant of every entry of the plans' tracks."""
    rows = plans.select(*by, parsed(F.col(json)).alias("_v")).withColumn("duration", finite(field(F.col("_v"), "$.duration")))
    entry = lambda track: lambda x, i: F.struct(F.lit(track).alias("track"), i.alias("i"), made(x).alias(name))
    tracks = (F.transform(F.try_variant_get(F.col("_v"), f"$.fx.{t}", "array<variant>"), entry(t)) for t in TRACKS)
    each = F.flatten(F.filter(F.array(*tracks), lambda x: x.isNotNull()))
    return rows.select(*by, F.when(F.col("duration") > 0, F.col("duration")).alias("duration"), F.inline(each))


def items(plans: DataFrame, by: list[str], json: str = "json") -> DataFrame:
    """by, track, i, duration and item (JSON text) of every entry of the plans' tracks."""
    return _entries(plans, by, json, "item", json_text)


def normal_items(plans: DataFrame, catalog: DataFrame, by: list[str], fill: bool = False, json: str = "json") -> tuple[DataFrame, DataFrame]:
    """(by, track, i, id, item) of the items that are good, item as JSON text; and (by, track, i, reason) of those dropped: not_object, unknown_kind or no_times.

    Ranges are put in order, into the plan and to a least length; a missing, repeated or blank id is replaced by the next number behind the track's largest.
    """
    key = lambda i: F.element_at(F.create_map(*(x for t, v in TRACKS.items() for x in (F.lit(t), F.lit(v[i])))), F.col("track"))
    rows = _entries(plans, by, json, "_fields", members)
    rows = rows.withColumns({"_m": F.coalesce("_fields", F.create_map().cast("map<string,string>")), "_object": F.col("_fields").isNotNull()})
    at = lambda k: F.try_element_at(F.col("_m"), F.lit(k))
    untitled = (F.col("track") == "text") & (F.coalesce(at("preset"), F.lit(NONE)).isin(NONE, '""', "false", "0"))
    rows = rows.withColumn("_m", F.when(untitled, put(F.col("_m"), preset=F.lit(f'"{TEXT_PRESET}"'))).otherwise(F.col("_m")))
    named = F.try_element_at(F.col("_m"), key(1))
    rows = rows.withColumns({"kind": F.when(is_a(named, '"'), plain(named)), "_start": finite(at("start")), "_end": finite(at("end")), "_at": finite(at("at"))})
    rules = catalog.groupBy("track", "kind").agg(F.sort_array(F.collect_list(F.struct("param", "type", "low", "high", "step", "opts", "size", "listed", "nullable", F.coalesce("required", F.lit(False)).alias("required"), "default"))).alias("_rules"))
    few = rules.limit(SMALL + 1).count() <= SMALL
    rows = rows.join(F.broadcast(rules) if few else rules, ["track", "kind"], "left")

    start, end, d, event = F.col("_start"), F.col("_end"), F.col("duration"), key(2)
    known = start.isNotNull() & end.isNotNull()
    low = F.when(known, F.greatest(F.lit(0.0), F.least(start, end)))
    high = F.when(known, F.when(d.isNull(), F.greatest(start, end)).otherwise(F.least(F.greatest(start, end), d)))
    short = high - low < SHORTEST
    beyond = F.coalesce(low + SHORTEST > d, F.lit(False))
    a = F.when(short & beyond, F.greatest(F.lit(0.0), d - SHORTEST)).otherwise(low)
    b = F.when(short & beyond, d).when(short, low + SHORTEST).otherwise(high)
    timed = F.when(event, F.col("_at").isNotNull()).otherwise(known & (d.isNull() | (low < d)))
    reason = F.when(~F.col("_object"), "not_object").when(F.col("_rules").isNull(), "unknown_kind").when(~timed, "no_times")
    rows = rows.withColumn("reason", reason)
    dropped = rows.where("reason is not null").select(*by, "track", "i", "reason")

    off = lambda k: F.coalesce(at(k), F.lit("false")).isin("false", NONE, "0", '""', "[]", "{}")
    common = dict(enabled=truth(F.when(at("enabled").isNull(), F.lit(True)).otherwise(~off("enabled"))), locked=truth(~off("locked")), src=F.when(at("src").isin('"ai"', '"user"'), at("src")).otherwise('"ai"'))
    strength = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(finite(at("intensity")), F.lit(1.0)))))
    ranged = put(F.col("_m"), start=written(F.round(a, 4)), end=written(F.round(b, 4)), intensity=written(strength), z=F.when(finite(at("z")).isNotNull(), written(F.bround(finite(at("z"))))), **common)
    when = F.greatest(F.lit(0.0), F.col("_at"))
    pointed = put(F.col("_m"), at=written(F.round(F.when(d.isNull(), when).otherwise(F.least(when, d)), 4)), **common)
    good = rows.where("reason is null").withColumn("_m", F.when(event, pointed).otherwise(ranged))
    own = F.filter("_rules", lambda r: r["param"].isNotNull())
    good = good.withColumn("_m", ruled(F.col("_m"), own, fill))
    cut = F.least(F.lit(2.0), F.greatest(F.lit(0.05), F.coalesce(finite(at("dur")), F.lit(0.35))))
    good = good.withColumn("_m", F.when(F.col("track") == "transitions", put(F.col("_m"), dur=written(cut))).otherwise(F.col("_m")))

    track = Window.partitionBy(*by, "track")
    good = good.withColumn("_id", F.when(is_a(at("id"), '"') & (F.trim(plain(at("id"))) != ""), plain(at("id"))))
    repeated = F.col("_id").isNull() | (F.row_number().over(Window.partitionBy(*by, "track", "_id").orderBy("i")) > 1)
    good = good.withColumn("_new", repeated.cast("int"))
    largest = F.coalesce(F.max(F.regexp_extract("_id", "^(?:tx|gr|cw|fx|tr|sf)_([0-9]{1,18})$", 1).try_cast("long") * F.startswith("_id", key(0)).cast("int")).over(track), F.lit(0))
    place = F.sum("_new").over(track.orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    name = F.when(F.col("_new") == 1, F.concat(key(0), F.lit("_"), (largest + place).cast("string"))).otherwise(F.col("_id"))
    good = good.withColumn("id", name).withColumn("_m", put(F.col("_m"), id=quoted(F.col("id"))))
    return good.select(*by, "track", "i", "id", as_object(F.col("_m")).alias("item")), dropped


def migrated(plan: Column, defaults: str, custom: Column | None = None, but: tuple[str, ...] = ()) -> Column:
    """A plan's JSON (version 1 or 2) with version 2, shots, and the fields of SECTIONS filled from defaults (JSON), none that is there replaced.

    custom is JSON with a version 1 plan's caption options: cap_pos, cap_color, base_color, cap_case and cap_scale, which count for those plans only.
    but names fields of fx that are left out.
    """
    return let(parsed(plan), lambda v: _migrated(v, defaults, custom, but))


def _migrated(v: Column, defaults: str, custom: Column | None, but: tuple[str, ...]) -> Column:
    base = parsed(F.lit(defaults))
    top = fields(v, but=("fx",))
    fx = fields(v, "$.fx", but)
    filled = {s: over(fields(base, f"$.{s}"), fields(v, f"$.{s}")) for s in SECTIONS}
    if custom is not None:
        c = fields(parsed(custom))
        at = lambda k: F.try_element_at(c, F.lit(k))
        caps, size = filled["fx.captions"], finite(F.try_element_at(fields(base, "$.fx.captions"), F.lit("size")))
        now = lambda k: F.try_element_at(caps, F.lit(k))
        color = lambda k: F.when(is_a(at(k), '"'), quoted(colored(plain(at(k)))))
        scaled = F.when(finite(at("cap_scale")) != 0, written(F.round(F.least(F.lit(0.12), F.greatest(F.lit(0.02), size * finite(at("cap_scale")))), 4)))
        low = F.when(finite(at("cap_pos")).isNotNull(), written(F.least(F.lit(0.9), F.greatest(F.lit(0.1), finite(at("cap_pos"))))))
        case = F.when(at("cap_case").isin('"none"', '"upper"', '"lower"', '"title"'), at("cap_case"))
        old = put(caps, y=F.coalesce(low, now("y")), accent=F.coalesce(color("cap_color"), now("accent")), color=F.coalesce(color("base_color"), now("color")), case=F.coalesce(case, now("case")), size=F.coalesce(scaled, now("size")))
        is_new = F.coalesce(F.try_element_at(top, F.lit("version")) == str(VERSION), F.lit(False)) & F.try_variant_get(v, "$.fx", "map<string,variant>").isNotNull()
        filled["fx.captions"] = F.when(is_new, caps).otherwise(old)
    shots = F.try_element_at(top, F.lit("shots"))
    block = put(fx, **{s[3:]: as_object(m) for s, m in filled.items() if s.startswith("fx.")})
    return as_object(put(top, version=F.lit(str(VERSION)), shots=F.when(is_a(shots, "["), shots).otherwise("[]"), fx=as_object(block), **{s: as_object(m) for s, m in filled.items() if "." not in s}))


def normalised(plans: DataFrame, catalog: DataFrame, defaults: str, by: list[str], fill: bool = False) -> tuple[DataFrame, DataFrame]:
    """(by, json) of every plan, migrated and normalised, and (by, track, i, reason) of the items dropped.

    Besides the items: heights of captions, silences, swells and the music's drop are cleaned and put in order of time. One join by plan brings a plan's tracks back; a plan without items keeps empty ones.
    """
    whole = plans.select(*by, migrated(F.col("json"), defaults, but=tuple(TRACKS)).alias("json"))
    good, dropped = normal_items(plans, catalog, by, fill)
    entry = F.sort_array(F.collect_list(F.struct("i", "item")))
    tracks = good.groupBy(*by, "track").agg(as_array(F.transform(entry, lambda x: x["item"])).alias("_list")).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("track", "_list"))).alias("_tracks"))
    rows = whole.join(tracks, by, "left").withColumn("_v", parsed(F.col("json")))
    v, top = F.col("_v"), fields(F.col("_v"))
    d = finite(F.try_element_at(top, F.lit("duration")))
    d = F.when(d > 0, d)
    music = fields(v, "$.fx.music")
    drop = finite(F.try_element_at(music, F.lit("drop_at")))
    drop = F.when(F.map_contains_key(music, "drop_at"), F.coalesce(F.when(drop.isNotNull(), written(F.round(_bounded(drop, d), 4))), F.lit(NONE)))
    music = put(music, stops=stops(listed(v, "$.fx.music.stops"), d), swells=swells(listed(v, "$.fx.music.swells"), d), drop_at=drop)
    captions = put(fields(v, "$.fx.captions"), y_ranges=caption_heights(listed(v, "$.fx.captions.y_ranges"), d))
    lists = {t: F.coalesce(F.try_element_at(F.col("_tracks"), F.lit(t)), F.lit("[]")) for t in TRACKS}
    named = F.transform_values(fields(v, "$.entities"), lambda _, x: F.when(x == NONE, '""').when(is_a(x, '"'), x).otherwise(quoted(x)))
    fx = put(fields(v, "$.fx"), music=as_object(music), captions=as_object(captions), **lists)
    return rows.select(*by, as_object(put(top, fx=as_object(fx), entities=as_object(named))).alias("json")), dropped
