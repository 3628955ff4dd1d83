"""A compiler from nested document types to one expression that lists what is wrong with a document.

Documents are JSON texts or VARIANT columns, so their values may be of any type.  A type is a tree of
Leaf (a test of one value), Group (an object with fields and rules between them)
and Many (an array of one type).  A cast of a variant costs as much for one number as the
reading of many fields, so a document is read once, as the struct that the tree knows, from its JSON with
every value made a text that still says its type (marked()): a blank stands before what was a text and behind a
number, true, false and null.  Every test is one of strings then.  with_issues()
turns the tree into one column of
array<struct<path, code, message>>: every issue is found in one pass over the row,
with array indices in its path, and none hides another.
Rules see the object (v), its index (i) and whatever an outer level has named,
such as the ids of other collections, so references are checked in the row too:
a document is its own group, nothing is shuffled, and a table of any size is a scan.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field
from functools import lru_cache
from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ISSUES = "array<struct<path:string,code:string,message:string>>"
NONE = f"cast(array() as {ISSUES})"
names = itertools.count()


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Names of fields before a null that counts (NAMES), other texts (names of fields, too) and other values of JSON, and what is put there: a text begins with a blank, all else ends with one.
TOKENS, MARKED = r'"(?:(NAMES)"(?=\s*+:\s*+null)|([^"\\]*+(?:\\.[^"\\]*+)*+)")|([^\s"{}\[\]:,]++)', '"$1$3 $2"'
NULL = "'null '"


def get(v: str, path: str, kind: str = "json") -> str:
    """SQL: a field (null where it is missing) of an object: as it is marked, or as a string, double or int."""
    value = v + "".join(f"[' {name}']" for name in path.split("."))
    if kind == "json":
        return value
    return string_of(value) if kind == "string" else f"try_cast({VALUE.format(x=value)} as {kind})"


def string_of(x: str) -> str:
    """SQL: a text without its mark, another value as a variant has it, null for null."""
    return f"if(startswith({x}, ' '), substring({x}, 2), try_variant_get(try_parse_json({x}), '$', 'string'))"


def listed(x: str, kind: str = "array<string>") -> str:
    """SQL: the items (or with a map the fields) of a value; null for a value that has none."""
    return f"if({IS['object'].format(x=x) if kind.startswith('map') else f"startswith({x}, '[')"}, from_json({x}, '{kind}'), null)"


def text_of(v: str, path: str) -> str:
    """SQL: a field if it is a text that isn't blank, else null."""
    x = get(v, path)
    return f"if({IS['text'].format(x=x)}, substring({x}, 2), null)"


def number_of(v: str, path: str) -> str:
    return f"if({IS['number'].format(x=get(v, path))}, {VALUE.format(x=get(v, path))}, null)"


def let(value: str, body) -> str:
    """SQL: body(name) with the name bound to the value, which is worked out once."""
    name = f"x{next(names)}"
    return f"transform(array({value}), {name} -> {body(name)})[0]"


def null_of(x: str) -> str:
    """SQL: whether a value is the null of JSON."""
    return f"coalesce({x} = {NULL}, false)"


def null_at(v: str, name: str) -> str:
    """SQL: whether null stands where an object or array may be null (see shape())."""
    return f"{v}['{name} '] is not null"


def matching(pattern: str) -> str:
    """SQL test of {x}: a text of this form from its start on; the pattern has no braces."""
    return "coalesce({x} rlike " + quoted("^ " + pattern) + ", false)"


TEXT, NUMBER = "coalesce(startswith({x}, ' '), false)", "coalesce({x} >= '-' and {x} < ':', false)"
VALUE = "try_cast({x} as double)"
#: Tests of one value {x}, marked and perhaps missing; each is true or false.  Of the first characters only that of objects comes after z.
IS = {
    "text": "coalesce({x} >= ' !' and {x} < '!' or {x} rlike " + quoted(r"^ \s*+\S") + ", false)",
    "number": NUMBER,
    "from 0": f"{NUMBER} and {VALUE} >= 0",
    "over 0": f"{NUMBER} and {VALUE} > 0",
    "integer": f"{NUMBER} and {VALUE} = floor({VALUE})",
    "integer from 0": f"{NUMBER} and {VALUE} >= 0 and {VALUE} = floor({VALUE})",
    "integer over 0": f"{NUMBER} and {VALUE} > 0 and {VALUE} = floor({VALUE})",
    "latitude": f"{NUMBER} and {VALUE} between -90 and 90",
    "longitude": f"{NUMBER} and {VALUE} between -180 and 180",
    "boolean": "coalesce({x} in ('true', 'false', 'true ', 'false '), false)",
    "object": "coalesce({x} > 'z', false)",
    "date": matching("[0-9][0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9]$") + " and try_to_timestamp(substring({x}, 2), 'yyyy-MM-dd') is not null",
    "time": TEXT + " and try_cast(substring({x}, 2) as timestamp) is not null",
    "slug": matching("[a-z0-9]+(-[a-z0-9]+)*$"),
    "clock": matching("([01][0-9]|2[0-3]):[0-5][0-9]$"),
    "sha256": matching("[0-9a-fA-F]+$") + " and length({x}) = 65",
    "texts": "coalesce(forall(" + listed("{x}") + ", y -> startswith(y, ' ')), false)",
    "whole texts": "coalesce(forall(" + listed("{x}") + ", y -> startswith(y, ' ') and trim(substring(y, 2)) <> ''), false)",
}


def one_of(*values: str) -> str:
    return f"coalesce({{x}} in ({', '.join(quoted(' ' + v) for v in values)}), false)"


@dataclass(frozen=True)
class Leaf:
    """A value that must pass `test` (a name of IS, or SQL of {x}).  null: JSON null may stand; missing: it may be left out."""

    test: str
    code: str = "invalid-value"
    null: bool = False
    missing: bool = False
    message: str = ""

    def bad(self, x: str) -> str:
        """SQL: whether the value fails."""
        fails = f"not ({IS.get(self.test, self.test).format(x=x)})"
        if self.null:
            fails = f"not {null_of(x)} and {fails}"
        return f"{x} is not null and {fails}" if self.missing else fails


@dataclass(frozen=True)
class Rule:
    """A condition between fields that is wrong (SQL of {v}, {i} and outer names; null is not wrong), told at `at` below the object ("=at": below the root)."""

    at: str
    code: str
    wrong: str
    message: str = ""


@dataclass(frozen=True)
class Group:
    fields: dict
    rules: tuple[Rule, ...] = ()
    code: str = "invalid-type"
    null: bool = False
    #: Names for rules below: name -> SQL of {v} and {i}.
    bound: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Many:
    item: Group | Leaf
    code: str = "invalid-type"
    null: bool = False
    #: Rules of the whole array: SQL of {a}; and of each item that is a Leaf: SQL of {v} and {i}.
    rules: tuple[Rule, ...] = ()
    each: tuple[Rule, ...] = ()
    bound: dict = field(default_factory=dict)


#: What a code says where a rule has no message of its own.
MESSAGES = {
    "invalid-root": "the document must be an object", "unsupported-schema-version": "this version of the schema can't be read", "missing-required": "a value is required",
    "invalid-value": "the value isn't allowed", "invalid-type": "the value has the wrong type", "invalid-enum": "the value is none of those known", "invalid-date": "not a date (YYYY-MM-DD)",
    "invalid-datetime": "not a point in time (ISO 8601)", "invalid-provenance": "where the data come from is missing or no object", "unknown-timezone": "no such time zone",
    "unknown-reference": "no entity has this id", "duplicate-reference": "the id stands here before", "duplicate-id": "another entity has this id",
    "non-contiguous-index": "the index must count from 0 without gaps", "non-contiguous-order": "the orders must count from 0 without gaps", "duplicate-order": "the order stands here before",
    "non-increasing-distance": "distances must grow from point to point", "inconsistent-range": "the end lies before the start", "inconsistent-date-range": "the last day lies before the first",
    "inconsistent-timestamps": "changed before it was made", "inconsistent-schema-version": "not the version of the document", "inconsistent-metadata-calendar": "not what the calendar says",
    "inconsistent-calendar": "a day has a date only if the calendar has", "inconsistent-day-date": "not the date that the day must have", "inconsistent-duration": "the parts don't add up to the whole",
    "unexpected-value": "no value may stand here", "invalid-reference": "the entity is of another kind", "route-mismatch": "the entity belongs to another route",
    "day-mismatch": "the entity belongs to another day", "duplicate-stage-for-day": "several stages name one day", "inconsistent-relationship": "the two don't name each other",
    "duplicate-override": "the same field is overridden twice",
}


def issue(path: str, code: str, message: str) -> str:
    return f"named_struct('path', {path}, 'code', {quoted(code)}, 'message', {quoted(message or MESSAGES[code])})"


def below(path: str, name: str) -> str:
    if not name:
        return path
    if name.startswith("="):
        return quoted(name[1:])
    return quoted(name) if path == "''" else f"concat({path}, {quoted('.' + name)})"


def named(bound: dict, context: dict, body) -> str:
    """SQL: body(context) with every bound name worked out once, in order."""
    if not bound:
        return body(context)
    (name, sql), rest = next(iter(bound.items())), dict(list(bound.items())[1:])
    return let(sql.format(**context), lambda x: named(rest, context | {name: x}, body))


def looked_at(node: Group) -> set[tuple[str, ...]]:
    """Paths below an object that its own rules look at."""
    told = " ".join([r.wrong for r in node.rules] + [b if isinstance(b, str) else b[1] for b in node.bound.values()])
    return {tuple(re.findall(r"\[' (\w+)'\]", chain)) for chain in re.findall(r"\{v\}((?:\[' \w+'\])+)", told)}


def parts_of(node: Group, more: frozenset = frozenset()) -> dict:
    """Fields that are read of an object: name -> its type and the paths below it that are looked at from above."""
    asked = looked_at(node) | more
    known = dict(node.fields) | {path[0]: Leaf("text") for path in sorted(asked) if path[0] not in node.fields}
    return {name: (n, frozenset(path[1:] for path in asked if path[0] == name and len(path) > 1)) for name, n in known.items()}


def raw(node) -> bool:
    """Whether an item of an array is read as a text only: nothing else tells null from other values that have no fields."""
    return isinstance(node, Leaf) or node.null


def shape(node, more: frozenset = frozenset()) -> str:
    """The type that a value is read with.  A field that may be null has one beside it that is there if it is null."""
    if isinstance(node, Leaf):
        return "string"
    if isinstance(node, Many):
        return f"array<{'string' if raw(node.item) else shape(node.item)}>"
    fields = [(name, n, shape(n, below_)) for name, (n, below_) in parts_of(node, more).items()]
    return f"struct<{','.join(f'` {name}`:{kind}' + (f',`{name} `:string' if not isinstance(n, Leaf) and n.null else '') for name, n, kind in fields)}>"


def opened(node, x: str, more: frozenset = frozenset()) -> str:
    """SQL: a value as shape() has it from its marked JSON, level by level: null is what isn't of its type, and nothing else."""
    if isinstance(node, Leaf):
        return x
    if isinstance(node, Many):
        y = f"x{next(names)}"
        return listed(x) if raw(node.item) else f"transform({listed(x)}, {y} -> {opened(node.item, y)})"
    fields = parts_of(node, more)
    nulls = [name for name, (n, _) in fields.items() if not isinstance(n, Leaf) and n.null]
    texts = f"struct<{','.join([f'` {name}`:string' for name in fields] + [f'`{name} `:string' for name in nulls])}>"

    def whole(v: str) -> str:
        values = []
        for name, (n, below_) in fields.items():
            values.append(f"' {name}', {opened(n, get(v, name), below_)}")
            if name in nulls:
                values.append(f"'{name} ', if({null_of(get(v, name))}, {NULL}, {v}['{name} '])")
        return f"if({v} is null, null, named_struct({', '.join(values)}))"

    return let(f"if({IS['object'].format(x=x)}, from_json({x}, '{texts}'), null)", whole)


def fields_in(node: Group) -> list[str]:
    """The fields of an object as shape() names them."""
    return [x for name, (n, _) in parts_of(node).items() for x in ([f" {name}", f"{name} "] if not isinstance(n, Leaf) and n.null else [f" {name}"])]


def null_names(node) -> set[str]:
    """Names of the fields of a tree that are objects or arrays and may be null."""
    if isinstance(node, Leaf):
        return set()
    if isinstance(node, Many):
        return null_names(node.item)
    return {name for name, n in node.fields.items() if not isinstance(n, Leaf) and n.null}.union(*(null_names(n) for n in node.fields.values()))


def leaf_names(node) -> set[str]:
    """Names of the fields of a tree that are read as they stand."""
    if isinstance(node, Leaf):
        return set()
    if isinstance(node, Many):
        return leaf_names(node.item)
    return {name for name, (n, _) in parts_of(node).items() if isinstance(n, Leaf)}.union(*(leaf_names(n) for n in node.fields.values()))


def marked(json: Column, node: Group) -> Column:
    """JSON with all values as marked texts; the name of an object or array that may be null is marked as other values are where it is null."""
    kept = "|".join(sorted(null_names(node) - leaf_names(node)))
    return F.regexp_replace(json, F.lit(TOKENS.replace("NAMES", kept or r"\b\B")), F.lit(MARKED))


def node_sql(node, x: str, path: str, context: dict, null: str = "") -> str:
    """SQL: the issues of value `x` (as shape() has it) at `path` (SQL); null: SQL that tells whether it is the null that it may be."""
    if isinstance(node, Leaf):
        return f"if({node.bad(x)}, array({issue(path, node.code, node.message)}), {NONE})"
    own, sql = ("a", array_sql) if isinstance(node, Many) else ("v", group_sql)
    body = named(node.bound, context | {own: x}, lambda c: sql(node, x, path, c))
    body = f"if({x} is null, array({issue(path, node.code, '')}), {body})"
    return f"if({null}, {NONE}, {body})" if null else body


def own_sql(node: Group, v: str, path: str, context: dict) -> str:
    """SQL: the issues of an object's values and of its rules; the list of them is only made where there is one."""
    told = [(n.bad(get(v, k)), issue(below(path, k), n.code, n.message)) for k, n in node.fields.items() if isinstance(n, Leaf)]
    return told_sql(told + rules_sql(node.rules, path, context))


def rules_sql(rules: tuple[Rule, ...], path: str, context: dict) -> list[tuple[str, str]]:
    return [(r.wrong.format(**context), issue(below(path, r.at), r.code, r.message)) for r in rules]


def told_sql(told: list[tuple[str, str]]) -> str:
    if not told:
        return NONE
    return f"if(coalesce({' or '.join(f'({wrong})' for wrong, _ in told)}, false), array_compact(array({', '.join(f'if({wrong}, {what}, null)' for wrong, what in told)})), {NONE})"


def group_sql(node: Group, v: str, path: str, context: dict) -> str:
    deeper = [node_sql(n, get(v, k), below(path, k), context, null_at(v, k) if n.null else "") for k, n in node.fields.items() if not isinstance(n, Leaf)]
    own = own_sql(node, v, path, context)
    return f"concat({', '.join([own, *deeper])})" if deeper else own


def array_sql(node: Many, a: str, path: str, context: dict) -> str:
    x, i = f"x{next(names)}", f"x{next(names)}"
    here = f"concat({path}, '[', {i}, ']')"
    inner = context | {"i": i, "v": x}
    if isinstance(node.item, Leaf):
        item = told_sql([(node.item.bad(f"coalesce({x}, {NULL})" if node.item.null else x), issue(here, node.item.code, node.item.message)), *rules_sql(node.each, here, inner)])
    else:
        item = let(opened(node.item, x), lambda y: node_sql(node.item, y, here, inner | {"v": y}, f"{x} is null or {null_of(x)}")) if raw(node.item) else node_sql(node.item, x, here, inner)
    whole = rules_sql(node.rules, path, context)
    return f"concat({', '.join([f'flatten(transform({a}, ({x}, {i}) -> {item}))', *([told_sql(whole)] if whole else [])])})"


def with_issues(documents: DataFrame, node: Group, column: str, to: str = "issues") -> DataFrame:
    """Add `to`: all issues of a column of JSON texts or variants, array<struct<path, code, message>>; null documents (and texts that are no JSON) have the issue of their root.

    What the root names (with the layer that it is worked out in) stands in columns of projections below, once a row;
    the issues of each of its fields are an expression of their own, which keeps the
    nesting of lambdas, and with it the work of the analyzer, small.  A document is read in one go; where that fails, as
    something isn't an object or array that should be one, it is read again, level by level.
    """
    context = {"v": "_b_root", **{name: f"_b_{name}" for name in node.bound}}
    kind, json = dict(documents.dtypes)[column], F.col(f"`{column}`")
    text = F.when(F.try_parse_json(json).isNotNull(), json) if kind == "string" else F.to_json(json)
    whole = f"from_json(_b_text, '{shape(node)[:-1]},_b_bad:string>', map('columnNameOfCorruptRecord', '_b_bad'))"
    again = f"named_struct({', '.join(f"'{name}', _b_again['{name}']" for name in fields_in(node))}, '_b_bad', cast(null as string))"
    bound = documents.withColumn("_b_text", marked(text, node)).withColumn("_b_whole", F.expr(f"if(ltrim(_b_text) > 'z', {whole}, null)"))
    bound = bound.withColumn("_b_again", F.expr(opened(node, "if(_b_whole['_b_bad'] is not null, ltrim(_b_text), null)")))
    bound = bound.withColumn("_b_root", F.expr(f"if(_b_again is not null, {again}, _b_whole)"))
    for layer in range(1 + max((d for d, _ in node.bound.values()), default=-1)):
        bound = bound.select("*", *(F.expr(sql.format(**context)).alias(context[name]) for name, (d, sql) in node.bound.items() if d == layer))
    parts = [own_sql(node, context["v"], "''", context)]
    parts += [node_sql(n, get(context["v"], k), below("''", k), context, null_at(context["v"], k) if n.null else "") for k, n in node.fields.items() if not isinstance(n, Leaf)]
    told_apart = bound.select("*", *(F.expr(part).alias(f"_p_{i}") for i, part in enumerate(parts)))
    root = F.expr(f"array({issue("''", node.code, '')})")
    every = F.when(F.col("_b_root").isNotNull(), F.concat(*(F.col(f"_p_{i}") for i in range(len(parts))))).otherwise(root)
    return told_apart.select(*documents.columns, every.alias(to))


def document_issues(documents: DataFrame, node: Group, key: str, column: str) -> DataFrame:
    """key, path, code and message of everything wrong with the documents (a column of JSON texts or variants).

    explode_outer, as explode would make the optimizer infer a filter on the issues
    and push it below what is worked out once: everything would be worked out again.
    """
    found = with_issues(documents.select(key, column), node, column, "_issues")
    return found.select(key, F.explode_outer("_issues").alias("_i")).where("_i is not null").select(key, "_i.*")


@lru_cache(maxsize=1)
def zones() -> str:
    """SQL test: the name of a known time zone."""
    return one_of(*sorted(available_timezones() | {"UTC"}))


def each_of(collection: str, path: str) -> str:
    """SQL: a text of each item of a collection of the root."""
    return f"coalesce(transform({{{collection}_rows}}, y -> {text_of('y', path)}), cast(array() as array<string>))"


def before(known: str, own: str) -> str:
    """SQL: whether a value stands among those of the items before item {i}."""
    return f"array_contains(slice({known}, 1, {{i}}), {own})"


def unknown(reference: str, known: str) -> str:
    """SQL: a reference to no id (of a map, which is looked up faster than an array); what isn't a text is told elsewhere."""
    return f"{reference} is not null and {known}[{reference}] is null"


def met(target: str, reference: str, field_: str) -> str:
    """SQL: a text of the first entity that a reference names."""
    same_id = lambda asked: f"filter({{{target}_rows}}, y -> y[' id'] = {asked} and {IS['text'].format(x=get('y', 'id'))})"
    return let(let(f"concat(' ', {reference})", lambda asked: f"get({same_id(asked)}, 0)"), lambda y: text_of(y, field_))


text = Leaf("text", "missing-required")
some_text = Leaf("text", null=True)
some_time = Leaf("time", "invalid-datetime", null=True)
time = Leaf("time", "invalid-datetime")
some_number, some_from_0 = Leaf("number", null=True), Leaf("from 0", null=True)
flag = Leaf("boolean", "invalid-type")


def choice(*values: str, null: bool = False, missing: bool = False) -> Leaf:
    return Leaf(one_of(*values), "invalid-enum", null, missing)


#: What may stand in the fields of a trip's document.
UNITS, STATUSES = ("metric", "imperial"), ("draft", "ready", "archived")
DAY_TYPES, DAY_STATES, STAGE_STATES, PARSING = ("ride", "off", "transfer"), ("not-started", "partial", "complete"), ("pending", "valid", "needs-review"), ("pending", "success", "partial", "error")
CONFIDENCES, LEVELS, PAUSE_MODES = ("confirmed", "probable", "uncertain"), ("high", "medium", "low"), ("automatic", "custom")
POINT_TYPES = ("start", "end", "summit", "village", "passage", "resupply", "pause", "shelter", "lodging", "poi")
FEATURE_TYPES = ("city", "town", "village", "hamlet", "mountain-pass", "saddle", "peak")
PLACE_CATEGORIES = ("shelter", "bakery", "cafe-or-ice-cream", "water", "fast-food", "bike-service", "supermarket", "sports", "toilet")
LODGING_TYPES = ("hotel", "airbnb", "gite", "chambre-hotes", "hostel", "guest-house", "refuge", "camping")
SOURCE_TYPES = ("user", "gpx", "osm", "open-meteo", "generated", "migrated")
PROVIDERS = ("gpx", "osm", "osm-practical-places", "osm-route-enrichment", "postpass-route-enrichment", "open-meteo")
PROVIDER_STATES, DERIVED_STATES = ("not-configured", "pending", "success", "partial", "error"), ("not-generated", "stale", "partial", "fresh")
TARGETS = {"trip-day": "days", "ride-stage": "stages", "route-point": "routePoints", "climb": "climbs", "practical-place": "practicalPlaces", "accommodation": "accommodations"}
VERSION = 1

provenance = Group(
    {"sourceType": choice(*SOURCE_TYPES), "sourceId": some_text, "fetchedAt": some_time, "engineVersion": text, "confidence": choice(*LEVELS, null=True), "manuallyOverridden": flag},
    code="invalid-provenance",
)


def collection(name: str, fields: dict, rules: tuple[Rule, ...] = (), bound: dict | None = None) -> Many:
    """A collection of the root whose items have ids of their own."""
    own = text_of("{v}", "id")
    again = Rule("id", "duplicate-id", before(f"{{{name}_ids}}", own))
    return Many(Group({"id": text, **fields}, (again, *rules), bound=bound or {}))


def date_of(v: str, path: str) -> str:
    return f"if({IS['date'].format(x=get(v, path))}, {get(v, path, 'string')}, null)"


def is_null(v: str, path: str) -> str:
    return null_of(get(v, path))


def given(v: str, path: str) -> str:
    return f"({get(v, path)} is not null and not {is_null(v, path)})"


def same(x: str, y: str) -> str:
    return f"({x} <=> {y})"


def known(field_: str, target: str) -> Rule:
    return Rule(field_, "unknown-reference", unknown(text_of("{v}", field_), f"{{{target}_known}}"))


def ordered(low: str, high: str) -> Rule:
    return Rule(high, "inconsistent-range", f"{number_of('{v}', high)} < {number_of('{v}', low)}")


#: SQL: an item that is a text.
ITEM = string_of("{v}")
STAGE_ROUTE = "{routes_known}[" + text_of("{v}", "sourceRouteId") + "]"


def references(target: str, *more: Rule) -> Many:
    """Ids of other entities: each known, and once."""
    return Many(
        Leaf(TEXT, "invalid-type"), bound={"refs": f"transform({{a}}, y -> {string_of('y')})"},
        each=(Rule("", "duplicate-reference", before('{refs}', ITEM)), Rule("", "unknown-reference", unknown(ITEM, f"{{{target}_known}}")), *more),
    )


def of_route(target: str) -> Rule:
    return Rule("", "route-mismatch", f"not {same(met(target, ITEM, 'routeId'), '{stage_route}')} and {{{target}_known}}[{ITEM}] is not null and {{stage_route}} is not null")


WEATHER_POINT = met("routePoints", met("weather", ITEM, "routePointId"), "routeId")
TYPE = text_of("{v}", "type")
INDEX = f"if({IS['integer from 0'].format(x=get('{v}', 'index'))}, {get('{v}', 'index', 'int')}, null)"
OVERRIDE_KEY = (
    f"if({text_of('y', 'targetType')} in ({', '.join(quoted(t) for t in TARGETS)}) and {text_of('y', 'targetId')} is not null and {text_of('y', 'field')} is not null, "
    f"concat_ws('::', {text_of('y', 'targetType')}, {text_of('y', 'targetId')}, {text_of('y', 'field')}), null)"
)
TARGET_IDS = f"case {text_of('{v}', 'targetType')} " + " ".join(f"when {quoted(t)} then {{{c}_known}}" for t, c in TARGETS.items()) + " end"
geometry_points = Many(
    Group({"altitudeM": some_number}, (Rule("", "invalid-value", f"not ({IS['latitude'].format(x=get('{v}', 'latitude'))}) or not ({IS['longitude'].format(x=get('{v}', 'longitude'))})"),), code="invalid-value"), null=True,
)
profile_points = Many(
    Group(
        {"elevationM": some_number, "gradePercent": some_number},
        (
            Rule("", "invalid-value", f"not ({IS['from 0'].format(x=get('{v}', 'distanceKm'))})"),
            Rule("distanceKm", "non-increasing-distance", f"{number_of('{v}', 'distanceKm')} <= {number_of('get({points}, {i} - 1)', 'distanceKm')}"),
        ),
        code="invalid-value",
    ),
    bound={"points": "{a}"},
)
pauses = Many(
    Group(
        {"id": text, "active": flag, "routePointId": some_text, "durationSeconds": Leaf("from 0"), "order": Leaf("integer from 0"), "origin": choice(*PAUSE_MODES)},
        (
            Rule("id", "duplicate-id", before('{pause_ids}', text_of('{v}', 'id'))), known("routePointId", "routePoints"),
            Rule("order", "duplicate-order", before('{orders}', number_of('{v}', 'order'))),
            Rule("routePointId", "route-mismatch", f"{{target_route}} is not null and {{routePoints_known}}[{text_of('{v}', 'routePointId')}] is not null and "
                f"not {same(met('routePoints', text_of('{v}', 'routePointId'), 'routeId'), '{target_route}')}"),
        ),
    ),
    bound={"pause_ids": f"transform({{a}}, y -> {text_of('y', 'id')})", "orders": f"transform({{a}}, y -> if({IS['integer from 0'].format(x=get('y', 'order'))}, {number_of('y', 'order')}, null))"},
    rules=(Rule("", "non-contiguous-order", "size(array_compact({orders})) > 0 and array_sort(array_compact({orders})) <> transform(sequence(0, size(array_compact({orders})) - 1), j -> cast(j as double))"),),
)
COLLECTIONS = ("sourceFiles", "routes", "climbs", "routePoints", "practicalPlaces", "accommodations", "days", "weather", "stages")
DAYS = "coalesce(size({days_rows}), 0)"
TARGET_STAGE = met("stages", text_of("{v}", "stageId"), "sourceRouteId")

#: The whole document of a trip.
BUNDLE = Group(
    {
        "metadata": Group(
            {
                "id": text, "slug": Leaf("slug"), "name": text, "description": some_text, "createdAt": time, "updatedAt": time, "startDate": Leaf("date", "invalid-date", null=True),
                "endDate": Leaf("date", "invalid-date", null=True), "timezone": some_text, "language": text, "units": choice(*UNITS), "status": choice(*STATUSES), "engineVersion": text,
            },
            (
                Rule("updatedAt", "inconsistent-timestamps", f"try_cast({text_of('{v}', 'createdAt')} as timestamp) > try_cast({text_of('{v}', 'updatedAt')} as timestamp)"),
                Rule("timezone", "unknown-timezone", f"{text_of('{v}', 'timezone')} is not null and not ({zones().format(x=get('{v}', 'timezone'))})"),
            ),
            code="missing-required",
        ),
        "calendar": Group(
            {"startDate": Leaf("date", "invalid-date", null=True), "endDate": Leaf("date", "invalid-date", null=True), "timezone": some_text},
            (
                Rule("endDate", "inconsistent-date-range", f"{date_of('{v}', 'endDate')} < {date_of('{v}', 'startDate')}"),
                Rule("startDate", "missing-required", f"{date_of('{v}', 'startDate')} is null and {date_of('{v}', 'endDate')} is not null"),
                Rule("endDate", "missing-required", f"{date_of('{v}', 'startDate')} is not null and {date_of('{v}', 'endDate')} is null"),
                Rule("timezone", "missing-required", f"{date_of('{v}', 'startDate')} is not null and {is_null('{v}', 'timezone')}"),
                Rule("timezone", "unknown-timezone", f"{text_of('{v}', 'timezone')} is not null and not ({zones().format(x=get('{v}', 'timezone'))})"),
            ),
            code="missing-required",
        ),
        "sourceFiles": collection("sourceFiles", {
            "originalName": text, "mimeType": text, "sizeBytes": Leaf("integer from 0"), "lastModifiedAt": some_time, "sha256": Leaf("sha256", null=True), "importedAt": time,
            "parsingStatus": choice(*PARSING), "parsingErrors": Leaf("whole texts", "invalid-type"),
        }),
        "routes": collection("routes", {
            "sourceFileId": some_text, "parsingStatus": choice(*PARSING), "parsingErrors": Leaf("whole texts", "invalid-type"), "provenance": provenance,
            "segments": Many(Group(
                {"index": Leaf("integer from 0"), "name": some_text, "distanceKm": some_from_0, "elevationGainM": some_from_0, "elevationLossM": some_from_0},
                (Rule("index", "non-contiguous-index", f"{INDEX} <> {{i}}"),),
            )),
            "geometry": Group({"full": geometry_points, "simplified": geometry_points}, null=True),
            "profile": Group({"resampleIntervalMeters": Leaf("over 0"), "points": profile_points}, null=True),
        }, (known("sourceFileId", "sourceFiles"),)),
        "climbs": collection("climbs", {
            "routeId": text, "name": some_text, "startDistanceKm": Leaf("from 0"), "endDistanceKm": Leaf("from 0"), "elevationGainM": Leaf("from 0"), "averageGradientPercent": Leaf("number"),
            "maxGradientPercent": some_number, "startAltitudeM": some_number, "endAltitudeM": some_number, "confidence": choice(*CONFIDENCES), "provenance": provenance,
        }, (known("routeId", "routes"), ordered("startDistanceKm", "endDistanceKm"))),
        "routePoints": collection("routePoints", {
            "routeId": text, "type": choice(*POINT_TYPES), "name": text, "latitude": Leaf("latitude"), "longitude": Leaf("longitude"), "elevationM": some_number, "trackDistanceKm": some_from_0,
            "osmFeatureType": choice(*FEATURE_TYPES, null=True, missing=True), "lateralDistanceKm": Leaf("from 0", null=True, missing=True), "provenance": provenance,
        }, (known("routeId", "routes"),)),
        "practicalPlaces": collection("practicalPlaces", {
            "category": choice(*PLACE_CATEGORIES), "name": some_text, "latitude": Leaf("latitude"), "longitude": Leaf("longitude"), "description": some_text, "trackDistanceKm": some_from_0,
            "detourKm": some_from_0, "openingHours": some_text, "hidden": flag, "pinned": flag, "stageId": Leaf("text", null=True, missing=True), "provenance": provenance,
            "usefulTags": Leaf("object", "invalid-type", null=True, missing=True),
            "dayIds": Many(Leaf("text"), bound={"refs": f"transform({{a}}, y -> {ITEM.replace('{v}', 'y')})"}, each=(
                Rule("", "duplicate-reference", before('{refs}', ITEM)), Rule("", "unknown-reference", unknown(ITEM, "{days_known}")),
            )),
        }, (
            known("stageId", "stages"),
            Rule("usefulTags", "invalid-value", f"exists(map_entries({listed(get('{v}', 'usefulTags'), 'map<string,string>')}), y -> trim(substring(y.key, 2)) = '' or not ({IS['text'].format(x='y.value')}))"),
        )),
        "accommodations": collection("accommodations", {
            "name": text, "type": choice(*LODGING_TYPES), **{k: some_text for k in ("address", "mapsUrl", "website", "phone", "bookingReference", "notes")},
            "latitude": Leaf("latitude", null=True), "longitude": Leaf("longitude", null=True), "confirmed": flag, "provenance": provenance,
        }),
        "days": collection("days", {
            "index": Leaf("integer from 0"), "displayNumber": Leaf("integer over 0"), "date": Leaf("date", "invalid-date", null=True), "type": choice(*DAY_TYPES), "startLocationName": some_text,
            "endLocationName": some_text, "accommodationId": some_text, "notes": some_text, "enrichmentStatus": choice(*DAY_STATES),
        }, (
            Rule("index", "non-contiguous-index", f"not ({INDEX} <=> {{i}})"),
            Rule("date", "inconsistent-calendar", f"{{cal_start}} is null and {given('{v}', 'date')}"),
            Rule("date", "missing-required", f"{{cal_start}} is not null and {INDEX} is not null and not {given('{v}', 'date')}"),
            Rule("date", "inconsistent-day-date", f"{date_of('{v}', 'date')} <> cast(date_add(cast({{cal_start}} as date), {INDEX}) as string)"),
            Rule("stageId", "missing-required", f"{TYPE} = 'ride' and {text_of('{v}', 'stageId')} is null"),
            Rule("stageId", "unexpected-value", f"{TYPE} in ('off', 'transfer') and not {is_null('{v}', 'stageId')}"),
            known("accommodationId", "accommodations"),
            Rule("stageId", "unknown-reference", f"{TYPE} = 'ride' and {unknown(text_of('{v}', 'stageId'), '{stages_known}')}"),
            Rule("stageId", "inconsistent-relationship", f"{TYPE} = 'ride' and {{stages_known}}[{text_of('{v}', 'stageId')}] is not null and "
                f"not {same(met('stages', text_of('{v}', 'stageId'), 'dayId'), text_of('{v}', 'id'))}"),
        )),
        "weather": collection("weather", {
            "dayId": text, "routePointId": some_text, "forDate": Leaf("date", "invalid-date"), "forecastAt": some_time, "temperatureMinC": some_number, "temperatureMaxC": some_number,
            "windSpeedKph": some_number, "precipitationMm": some_from_0, "weatherCode": Leaf("integer", null=True), "provenance": provenance,
        }, (
            known("dayId", "days"), known("routePointId", "routePoints"), ordered("temperatureMinC", "temperatureMaxC"),
            Rule("forDate", "inconsistent-day-date", f"{date_of('{v}', 'forDate')} <> {met('days', text_of('{v}', 'dayId'), 'date')}"),
        )),
        "stages": collection("stages", {
            "dayId": text, "sourceRouteId": text, "name": some_text, "startLocationName": some_text, "endLocationName": some_text,
            **{k: some_from_0 for k in ("distanceKm", "elevationGainM", "elevationLossM", "movingDurationSeconds", "pauseDurationSeconds", "totalDurationSeconds")},
            "estimatedAverageSpeedKph": Leaf("over 0", null=True), "minAltitudeM": some_number, "maxAltitudeM": some_number, "validationStatus": choice(*STAGE_STATES),
            "metricsProvenance": Group(provenance.fields, code="invalid-provenance", null=True), "climbIds": references("climbs", of_route("climbs")), "routePointIds": references("routePoints", of_route("routePoints")),
            "weatherRecordIds": references(
                "weather", Rule("", "day-mismatch", f"{{weather_known}}[{ITEM}] is not null and {{stage_day}} is not null and not {same(met('weather', ITEM, 'dayId'), '{stage_day}')}"),
                Rule("", "route-mismatch", f"{{stage_route}} is not null and {WEATHER_POINT} <> {{stage_route}}"),
            ),
        }, (
            known("dayId", "days"), known("sourceRouteId", "routes"), ordered("minAltitudeM", "maxAltitudeM"),
            Rule("dayId", "invalid-reference", f"{{days_known}}[{{stage_day}}] is not null and not {same(met('days', '{stage_day}', 'type'), quoted('ride'))}"),
            Rule("metricsProvenance", "missing-required", f"{null_at('{v}', 'metricsProvenance')} and not ({' and '.join(is_null('{v}', k) for k in ('distanceKm', 'elevationGainM', 'elevationLossM'))})"),
            Rule("totalDurationSeconds", "inconsistent-duration", f"abs({number_of('{v}', 'movingDurationSeconds')} + {number_of('{v}', 'pauseDurationSeconds')} - {number_of('{v}', 'totalDurationSeconds')}) > 1e-9"),
            Rule("=stages", "duplicate-stage-for-day", "size(filter(slice({stages_dayId}, 1, {i}), y -> y = {stage_day})) = 1"),
        ), {"stage_route": STAGE_ROUTE, "stage_day": text_of("{v}", "dayId")}),
        "settings": Group({
            "global": Group({"referenceSpeedKph": Leaf("over 0"), "pausePlanMode": choice(*PAUSE_MODES)}, code="missing-required"),
            "days": Many(
                Group({"dayId": text, "departureTime": Leaf("clock", null=True), "totalBreakSeconds": some_from_0}, (known("dayId", "days"), Rule("dayId", "duplicate-id", before('{setting_days}', text_of('{v}', 'dayId'))))),
                bound={"setting_days": f"transform({{a}}, y -> {text_of('y', 'dayId')})"},
            ),
            "stages": Many(
                Group(
                    {"stageId": text, "pausePlanMode": choice(*PAUSE_MODES, null=True), "pauses": pauses}, (known("stageId", "stages"), Rule("stageId", "duplicate-id", before('{setting_stages}', text_of('{v}', 'stageId')))),
                    bound={"target_route": f"{{routes_known}}[{TARGET_STAGE}]"},
                ),
                bound={"setting_stages": f"transform({{a}}, y -> {text_of('y', 'stageId')})"},
            ),
        }, code="missing-required"),
        "overrides": Many(
            Group(
                {"id": text, "targetType": choice(*TARGETS), "targetId": text, "field": text, "reason": some_text, "createdAt": time},
                (
                    Rule("id", "duplicate-id", before('{override_ids}', text_of('{v}', 'id'))),
                    Rule("targetId", "unknown-reference", f"({TARGET_IDS})[{text_of('{v}', 'targetId')}] is null and {text_of('{v}', 'targetId')} is not null and {text_of('{v}', 'targetType')} in ({', '.join(quoted(t) for t in TARGETS)})"),
                    Rule("", "duplicate-override", before("{override_keys}", "get({override_keys}, {i})")),
                ),
            ),
            bound={"override_ids": f"transform({{a}}, y -> {text_of('y', 'id')})", "override_keys": f"transform({{a}}, y -> {OVERRIDE_KEY})"},
        ),
        "enrichmentMetadata": Group({"providers": Many(Group({
            "provider": choice(*PROVIDERS), "lastAttemptedAt": some_time, "lastSuccessAt": some_time, "status": choice(*PROVIDER_STATES), "message": some_text,
        }))}, code="missing-required"),
        "generatedMetadata": Group({"engineVersion": text, "generatedAt": some_time, "derivedDataStatus": choice(*DERIVED_STATES)}, code="missing-required"),
    },
    (
        Rule("schemaVersion", "unsupported-schema-version", f"not ({NUMBER.format(x=get('{v}', 'schemaVersion'))} and {get('{v}', 'schemaVersion', 'double')} = {VERSION})"),
        Rule("metadata.schemaVersion", "inconsistent-schema-version", f"{get('{v}', 'metadata')} is not null and not {same(get('{v}', 'metadata.schemaVersion', 'string'), get('{v}', 'schemaVersion', 'string'))}"),
        *(
            Rule(f"metadata.{k}", "inconsistent-metadata-calendar", f"{get('{v}', 'metadata')} is not null and {get('{v}', 'calendar')} is not null and not {same(get('{v}', f'metadata.{k}', 'string'), get('{v}', f'calendar.{k}', 'string'))}")
            for k in ("startDate", "endDate", "timezone")
        ),
        Rule("calendar.endDate", "inconsistent-duration", f"{DAYS} > 0 and {date_of('{v}', 'calendar.endDate')} <> cast(date_add(cast({{cal_start}} as date), {DAYS} - 1) as string)"),
    ),
    code="invalid-root",
    bound={
        "cal_start": (0, date_of("{v}", "calendar.startDate")), **{f"{c}_rows": (0, get("{v}", c)) for c in COLLECTIONS},
        **{f"{c}_ids": (1, each_of(c, "id")) for c in COLLECTIONS},
        **{f"{c}_known": (2, f"map_from_arrays(array_distinct(array_compact({{{c}_ids}})), array_distinct(array_compact({{{c}_ids}})))") for c in COLLECTIONS},
        "stages_dayId": (1, each_of("stages", "dayId")),
    },
)
