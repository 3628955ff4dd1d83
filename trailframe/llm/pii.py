"""Format-preserving pseudonyms for personal data, in Spark SQL functions only.

One regular expression finds candidates; numbers and dates are validated (Luhn,
octets, mod 97, calendar, number ranges).  A keyed Feistel network then permutes
each value within its own format: digits stay digits, letters keep their case,
separators stay, check digits are made anew, dates stay dates.  What is permuted
is the value and not its notation (the digits of a number, the day of a date),
and the notation is laid over the result.  A permutation never joins two values
and always maps a value to the same pseudonym, so equal values stay linked
across documents.  A text is split at the matches and joined again in its row:
there is no shuffle, and a hot source costs what its bytes cost.

A secret is what stands behind a name that says so (in any case, with words before
or behind it): all up to the next white space or quotation mark, but for punctuation
at its end.  Its letters and digits (ASCII) are permuted; other characters stay.

The round function is SHA-256 over key, round and the other half, so whoever
holds no key can't invert it.  The key is a parameter; keep it out of the code.

Defined results: null text stays null with nothing found; empty text stays
empty; candidates that fail their check stay as they are; overlapping
candidates: the first in the text, then the first kind in KINDS; texts, secrets
and host names of any length are read whole (an address whose parts are longer
than the standard lets them be is none); rows repeat as they come; an empty
table gives none; every other column passes through unchanged, whatever its
name (pii_text and pii_found are replaced).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailframe.llm.common import fresh

BEFORE, AFTER = r"(?<![0-9A-Za-z.+-])", r"(?![0-9A-Za-z]|[.-][0-9])"
#: Kinds in order of precedence, and the pattern of each.  No pattern nests repetitions of varying length.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})++(?![A-Za-z0-9-])",
    "secret": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{0,60}?(?i:passwords?|passwd|pwd|tokens?|secrets?|api[_-]?keys?|access[_-]?keys?|private[_-]?keys?)(?:[_-][A-Za-z0-9_-]{0,60})?"
    r"[\"']?\s{0,3}[=:]\s{0,3}[\"']?(?=[^\s\"']*[0-9])[^\s\"']{8,}(?<=[A-Za-z0-9_/+=-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}"
    r"| [A-Z0-9]{4}(?: (?=[A-Z]{0,3}[0-9])[A-Z0-9]{4}){1,6}(?: (?=[A-Z]{0,2}[0-9])[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+?1[ .-]?)?\([2-9][0-9]{2}\) ?[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9])"
    rf"|{BEFORE}(?:1[ .-])?[2-9][0-9]{{2}}[ .-][2-9][0-9]{{2}}[ .-][0-9]{{4}}{AFTER}"
    r"|(?<![0-9A-Za-z+])\+[1-9][0-9]{0,2}(?:[ .-][0-9]{2,4}){2,4}(?![0-9])|(?<![0-9A-Za-z+])\+[1-9][0-9]{7,14}(?![0-9])",
    "date": r"(?<![0-9A-Za-z.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})"
    r"(?![0-9])",
    "ip": r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{4}[ -]){3}[0-9]{4}(?![0-9])|(?<![0-9A-Za-z])[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}(?![0-9])"
    r"|(?<![0-9A-Za-z])[0-9]{13,19}(?![0-9])",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
#: Part of a secret that is kept: its name, or the fixed prefix of the key.
SECRET_HEAD = r"^(?:AKIA|[A-Za-z0-9_-]+[\"']?\s{0,3}[=:]\s{0,3}[\"']?)"
#: Country code of a telephone number, kept as well (the lengths of the codes are fixed: E.164); 1 may stand without a plus.
PHONE_LEAD = r"^(?:\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{1,3})|1(?=[ .-]?[(2-9]))"
ROUNDS = 8
#: Values of hex digits alone, and the most steps that another value walks until it is none of them (a chance of 1e-38 to need more).
HEX, WALK = "^[0-9a-f]*$", 60
#: Dates permute within the days from 1900-01-01 to 2099-12-31: 73,049 = 17 * 4,297.
FIRST_DAY, DAYS, DAY_PARTS = "1900-01-01", 73_049, (17, 4_297)
#: Social security numbers: areas 001-899 but for 666, groups 01-99, serials 0001-9999.
AREAS, GROUPS, SERIALS = 898, 99, 9_999
NONE = "cast(null as string)"


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(name: str, value: str, body: str) -> str:
    """SQL: body with `name` bound to value, which is worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def shifted(half: str, classes: str, other: str, key: str) -> str:
    """SQL: array `half` of characters, each moved within its class by the keyed hash of round and other half."""
    source = f"sha2(concat({quoted(key + '|')}, step, '|', array_join({other}, '')), 256)"
    digests = f"transform(sequence(0, cast(size({half}) div 32 as int)), b -> sha2(concat(source, '|', b), 256))"
    move = "cast(conv(substr(element_at(hs, cast(i div 32 as int) + 1), 2 * (i % 32) + 1, 2), 16, 10) as int)"
    alphabets = {
        "9": "0123456789", "n": "23456789", "z": "01", "h": "abcdef", "a": "abcdefghijklmnopqrstuvwxyz", "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    }
    letters = " ".join(f"when '{k}' then '{v}'" for k, v in alphabets.items())
    moved = let("v", f"case kinds[i] {letters} else '' end", f"if(v = '', c, substr(v, (locate(c, v) - 1 + {move}) % length(v) + 1, 1))")
    return let("kinds", classes, let("source", source, let("hs", digests, f"transform({half}, (c, i) -> {moved})")))


def permuted(text: str, key: str, phone: str = "false", hexes: str = "false") -> str:
    """SQL: string `text` permuted within the class of each of its characters.

    The output has the same classes, so the network permutes the strings of one
    format.  phone (SQL): the first and fourth digits are classes of their own,
    2-9 and 0-1.  hexes (SQL): values of hex digits alone are permuted among
    themselves, and all others walk on along their cycle until they are no hex
    value, so the two never meet.
    """
    lead = f"({phone}) and i in (0, 3)"
    kinds = (
        f"transform(cs, (c, i) -> case when {lead} and c rlike '[2-9]' then 'n' when {lead} and c rlike '[01]' then 'z' "
        "when hexed and c rlike '[a-f]' then 'h' when c rlike '[0-9]' then '9' when c rlike '[a-z]' then 'a' when c rlike '[A-Z]' then 'A' else '.' end)"
    )
    even = f"named_struct('l', {shifted('s.l', 'slice(ks, 1, h)', 's.r', key)}, 'r', s.r)"
    odd = f"named_struct('l', s.l, 'r', {shifted('s.r', 'slice(ks, h + 1, size(cs) - h)', 's.l', key)})"
    begun = "named_struct('l', slice(cs, 1, h), 'r', slice(cs, h + 1, size(cs) - h))"
    body = f"aggregate(sequence(0, {ROUNDS - 1}), {begun}, (s, step) -> if(step % 2 = 0, {even}, {odd}), s -> concat(array_join(s.l, ''), array_join(s.r, '')))"
    once = let("cs", "filter(split(p, ''), c -> c <> '')", let("ks", kinds, let("h", "cast(size(cs) div 2 as int)", body)))
    done = f"k > 0 and (hexed or not ({hexes}) or not p rlike '{HEX}')"
    return let("hexed", f"({hexes}) and ({text}) rlike '{HEX}'", f"aggregate(sequence(0, if({hexes}, {WALK}, 1)), {text}, (p, k) -> if({done}, p, {once}))")


def paired(state: str, key: str, rounds: int = 10) -> str:
    """SQL: a Feistel network over struct (a, b, m, n, tag) with a < m and b < n: in turn one moves by the keyed hash of the other."""
    digest = f"cast(conv(substr(sha2(concat({quoted(key + '|')}, t.tag, step, '|', if(step % 2 = 0, t.b, t.a)), 256), 1, 12), 16, 10) as bigint)"
    moved = "named_struct('a', if(step % 2 = 0, (t.a + d) % t.m, t.a), 'b', if(step % 2 = 0, t.b, (t.b + d) % t.n), 'm', t.m, 'n', t.n, 'tag', t.tag)"
    return f"aggregate(sequence(0, {rounds - 1}), {state}, (t, step) -> {let('d', digest, moved)})"


def pair(a: str, b: str, m: int, n: int, tag: str) -> str:
    return f"named_struct('a', cast({a} as bigint), 'b', cast({b} as bigint), 'm', cast({m} as bigint), 'n', cast({n} as bigint), 'tag', '{tag}')"


def luhn_sum(digits: str, doubled: int) -> str:
    """SQL: the Luhn sum of a digit string; from the right, the places of parity `doubled` are doubled."""
    d = f"cast(substr({digits}, -i - 1, 1) as int)"
    twice = f"if({d} > 4, 2 * {d} - 9, 2 * {d})"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (acc, i) -> acc + if(i % 2 = {doubled}, {twice}, {d}))"


def mod97(text: str) -> str:
    """SQL: letters count as 10..35, digits as themselves; the remainder by 97."""
    value = "cast(conv(c, 36, 10) as int)"
    return f"aggregate(filter(split({text}, ''), c -> c <> ''), 0, (acc, c) -> (acc * if({value} > 9, 100, 10) + {value}) % 97)"


def laid(shape: str, characters: str) -> str:
    """SQL: letters and digits of string `shape` give way to those of `characters`, in order."""
    before = f"length(regexp_replace(substr({shape}, 1, i), '[^0-9A-Za-z]', ''))"
    return f"array_join(transform(filter(split({shape}, ''), c -> c <> ''), (c, i) -> if(c rlike '[0-9A-Za-z]', substr({characters}, {before} + 1, 1), c)), '')"


#: Notations of dates; day first is tried before month first where slashes stand.
STYLES = (("^[0-9]{4}-", "yyyy-MM-dd"), ("^[0-9]{2}[.]", "dd.MM.yyyy"), ("^[0-9]{2}/(0[1-9]|1[0-2])/", "dd/MM/yyyy"), ("^[0-9]{2}/", "MM/dd/yyyy"))


def pseudonym(m: str, key: str) -> str:
    """SQL: struct (kind, to) for match `m`: what takes its place, null where validation fails."""
    kind = "case " + " ".join(f"when {m} rlike {quoted('^(?:' + pattern + ')$')} then '{name}'" for name, pattern in KINDS.items()) + " end"
    tld = f"regexp_extract({m}, '([.][A-Za-z0-9-]+)$', 1)"
    head = (
        f"case kind when 'secret' then regexp_extract({m}, {quoted('(' + SECRET_HEAD + ')')}, 1) "
        f"when 'phone' then regexp_extract({m}, {quoted('(' + PHONE_LEAD + ')')}, 1) when 'iban' then left({m}, 4) else '' end"
    )
    bare = f"regexp_replace(substr({m}, length(head) + 1), '[^0-9A-Za-z]', '')"
    body = (
        f"case kind when 'email' then left({m}, length({m}) - length({tld})) when 'secret' then substr({m}, length(head) + 1) "
        f"when 'card' then left({bare}, length({bare}) - 1) else {bare} end"
    )
    # ten digits behind no code or behind code 1 are one kind of number
    national = "kind = 'phone' and head in ('', '1', '+1')"
    check = f"lpad(cast(98 - {mod97("concat(p, left(head, 2), '00')")} as string), 2, '0')"
    whole = (
        f"case kind when 'email' then concat(p, {tld}) when 'secret' then concat(head, p) "
        f"when 'phone' then concat(head, {laid(f'substr({m}, length(head) + 1)', 'p')}) "
        f"when 'iban' then if({mod97('concat(body, head)')} = 1, {laid(m, f'concat(left(head, 2), {check}, p)')}, {NONE}) "
        f"when 'card' then if({luhn_sum(bare, 1)} % 10 = 0, {laid(m, f'concat(p, cast((10 - {luhn_sum("p", 0)} % 10) % 10 as string))')}, {NONE}) end"
    )
    text = let("head", head, let("body", body, let("p", permuted("body", key, national, "kind = 'secret'"), whole)))

    style = "case " + " ".join(f"when {m} rlike {quoted(shape)} then '{s}'" for shape, s in STYLES) + " end"
    days = f"case style {' '.join(f"when '{s}' then datediff(cast(try_to_timestamp({m}, '{s}') as date), date'{FIRST_DAY}')" for _, s in STYLES)} end"
    octet = lambda i: f"cast(split({m}, '[.]')[{i}] as bigint)"
    digits = lambda a, n: f"cast(substr({m}, {a}, {n}) as bigint)"
    whole_ip = f"forall(split({m}, '[.]'), o -> cast(o as int) < 256 and o rlike '^(0|[1-9][0-9]*)$')"
    whole_ssn = f"{digits(1, 3)} between 1 and 899 and {digits(1, 3)} <> 666 and {digits(5, 2)} > 0 and {digits(8, 4)} > 0"
    start = (
        f"case when kind = 'date' and days >= 0 and days < {DAYS} then {pair(f'days % {DAY_PARTS[0]}', f'days div {DAY_PARTS[0]}', *DAY_PARTS, 'date')} "
        f"when kind = 'ip' and {whole_ip} then {pair(f'{octet(0)} * 256 + {octet(1)}', f'{octet(2)} * 256 + {octet(3)}', 65_536, 65_536, 'ip')} "
        f"when kind = 'ssn' and {whole_ssn} then {pair(f'{digits(1, 3)} - if({digits(1, 3)} > 666, 2, 1)', f'({digits(5, 2)} - 1) * {SERIALS} + {digits(8, 4)} - 1', AREAS, GROUPS * SERIALS, 'ssn')} end"
    )
    day = f"date_add(date'{FIRST_DAY}', cast(q.a + q.b * {DAY_PARTS[0]} as int))"
    written = (
        f"case kind when 'date' then case style {' '.join(f"when '{s}' then date_format({day}, '{s}')" for _, s in STYLES)} end "
        "when 'ip' then concat_ws('.', q.a div 256, q.a % 256, q.b div 256, q.b % 256) "
        f"else concat_ws('-', lpad(cast(q.a + if(q.a >= 665, 2, 1) as string), 3, '0'), lpad(cast(q.b div {SERIALS} + 1 as string), 2, '0'), lpad(cast(q.b % {SERIALS} + 1 as string), 4, '0')) end"
    )
    number = let("style", style, let("days", days, let("start", start, f"if(start is null, {NONE}, {let('q', paired('start', key), written)})")))
    return let("kind", kind, f"named_struct('kind', kind, 'to', if(kind in ('date', 'ip', 'ssn'), {number}, {text}))")


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """Add pii_text, and pii_found: an array of the kinds found, in text order (null text: null and empty).

    key: the secret of the permutation.
    """
    text, pattern = F.col(text_col), F.lit(PATTERN)
    # most texts hold no digit and no @, and every kind needs one, but for a key of letters alone
    likely = text.rlike(r"[0-9@]|AKIA")
    found, made = fresh("found", docs.columns), fresh("made", docs.columns)
    marked = docs.withColumn(found, F.when(likely, F.regexp_extract_all(text, pattern, F.lit(0))))
    marked = marked.withColumn(made, F.expr(f"transform({found}, m -> {pseudonym('m', key)})"))
    joined = (
        f"array_join(zip_with(split(`{text_col}`, {quoted(PATTERN)}, -1), transform({made}, (x, i) -> coalesce(x.to, {found}[i])), "
        "(gap, to) -> concat(gap, coalesce(to, ''))), '')"
    )
    return (
        marked.withColumn("pii_text", F.when(F.size(found) > 0, F.expr(joined)).otherwise(text))
        .withColumn("pii_found", F.expr(f"coalesce(transform(filter({made}, x -> x.to is not null), x -> x.kind), array())"))
        .drop(found, made)
    )
