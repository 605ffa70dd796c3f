"""Text functions as Column builders. Each takes and returns Columns and runs in the JVM;
only the NFKC form of organisation names needs Python, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rules


#: Unicode's white space, as (?U)\s matches it.
BLANKS = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def none_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    """Without blanks at either end, all of Unicode's."""
    return F.btrim(c, F.lit(BLANKS))


def without_blanks(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", "")


def trim_to_null(c: Column) -> Column:
    return none_if_empty(strip(c))


def collapse(c: Column) -> Column:
    """Carriage returns dropped, runs of blanks as one space, stripped; '' for null."""
    return strip(F.regexp_replace(F.replace(or_empty(c), F.lit("\r"), F.lit("")), r"(?U)\s+", " "))


def first_group(c: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group, null where the pattern has no match or the group is empty."""
    return none_if_empty(F.regexp_extract(c, pattern, group))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, which the optimizer can't undo."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def first_contained(c: Column, words) -> Column:
    """The first of `words`, in their order, that the text contains; pairs name the result. The
    text is worked out once, and no word is looked for behind the one found."""
    pairs = [w if isinstance(w, tuple) else (w, w) for w in words]
    known = [(k, name) for keys, name in pairs for k in (keys if isinstance(keys, tuple) else (keys,))]
    return let(c, lambda text: reduce(lambda found, of: found.when(F.contains(text, F.lit(of[0])), of[1]), known, F))


def remove_first(c: Column, part: Column, tail: tuple[str, ...] = ()) -> Column:
    """The text without the first occurrence of `part`, and of one of the characters `tail` after
    it. Either argument is used once, so that chains of this stay small, and no pattern is made of
    `part`: that would be compiled for every row."""

    def of(given: Column) -> Column:
        text, gone = given["text"], given["part"]
        at, n = F.instr(text, gone), F.length(gone)
        if tail:
            n = n + F.when(F.substring(text, at + n, F.lit(1)).isin(*tail), 1).otherwise(0)
        return F.when((gone != "") & F.contains(text, gone), F.overlay(text, F.lit(""), at, n)).otherwise(text)

    return let(F.struct(c.alias("text"), part.alias("part")), of)


def clean_title(c: Column) -> Column:
    out = F.regexp_replace(collapse(c), rules.TITLE_NOISE, "")
    for pattern in (rules.TITLE_REGION, rules.TITLE_END, rules.TITLE_MARKS):
        out = F.regexp_replace(out, pattern, "")
    return strip(out)


def given_address(appeal: Column) -> Column:
    """The rest of an appeal's address line as it stands, '' if there is none."""
    return F.regexp_extract(F.replace(or_empty(appeal), F.lit("_x000D_"), F.lit("\n")), rules.ADDRESS_LINE, 1)


def address_line(given: Column, location: Column, title: Column) -> tuple[Column, Column]:
    """(line, source): the appeal's address line, else location, else title."""
    own = strip(F.regexp_replace(strip(given), rf"(?s){rules.ADDRESS_END}.*", ""))
    place, name = strip(or_empty(location)), strip(or_empty(title))
    pick = lambda *found: F.when(given != "", found[0]).when(place != "", found[1]).when(name != "", found[2]).otherwise(found[3])
    return pick(own, place, name, F.lit("")), pick(*map(F.lit, ("appeal_address", "location", "title", "unknown")))


def region(c: Column) -> Column:
    return F.coalesce(first_contained(c, rules.REGIONS), first_contained(c, rules.REGION_ALIASES))


def street(c: Column, where: Column | None = None) -> Column:
    """A known street by any of its names, else the first street-like word after the region
    (`where`, if it is known)."""
    known = first_contained(c, [(aliases, name) for name, aliases in rules.STREET_ALIASES])
    where = region(c) if where is None else where
    at = F.instr(c, where)
    scoped = F.when(at > 0, F.substring(c, at + F.length(where), F.length(c))).otherwise(c)
    return F.coalesce(known, first_group(scoped, rules.STREET))


def normal_street(c: Column) -> Column:
    out = F.regexp_replace(none_if_empty(c), r"(街道|镇|乡)(?:街道|镇|乡)+", "$1")
    return reduce(lambda x, pair: F.when(x == pair[0], F.lit(pair[1])).otherwise(x), rules.STREET_RENAMES, out)


def chinese_number(c: Column) -> Column:
    """Digits, one numeral, or tens and ones; null for anything else."""
    return let(F.regexp_replace(c, "^0+", ""), lambda bare: let(F.when(bare == "", "0").otherwise(bare), _number))


def _number(text: Column) -> Column:
    digit = F.create_map(*(F.lit(x) for pair in rules.CN_DIGITS.items() for x in pair))
    value = lambda x, default: F.coalesce(F.try_element_at(digit, x), F.lit(default))
    at = F.instr(text, "十")
    left, right = F.substring(text, F.lit(1), at - 1), F.substring(text, at + 1, F.length(text))
    tens = F.when(left == "", 1).otherwise(value(left, 1))
    ones = F.when(right == "", 0).otherwise(value(right, 0))
    return F.when(text.rlike("^[0-9]+$"), text.cast("long")).when(F.try_element_at(digit, text).isNotNull(), F.try_element_at(digit, text)).when(at > 0, tens * 10 + ones)


def numbered_component(c: Column) -> Column:
    """A building or floor with its number in digits and one form of its suffix."""

    def of(whole: Column, suffix: Column) -> Column:
        number = chinese_number(F.substring(whole, F.lit(1), F.length(whole) - F.length(suffix)))
        shown = F.when(F.lower(suffix) == "f", "楼").when(suffix == "棟", "栋").when(suffix.endswith("厂房"), "号厂房").otherwise(suffix)
        numbered = F.coalesce(F.concat(number.cast("string"), shown), F.replace(whole, F.lit("棟"), F.lit("栋")))
        return F.when(suffix == "", whole).otherwise(numbered)

    # Each value is worked out once: nested in plain columns they were some two hundred patterns a row.
    return let(c, lambda whole: let(F.regexp_extract(whole, rules.COMPONENT_SUFFIX, 1), lambda suffix: of(whole, suffix)))


def organization_in(c: Column) -> Column:
    """The first acceptable organisation name in one text."""

    def cleaned(name: Column) -> Column:
        out = F.regexp_replace(F.regexp_replace(name, rules.ORGANIZATION_ADDRESS, ""), rules.ORGANIZATION_VERB, "")
        for _ in range(3):
            out = F.regexp_replace(out, rules.ORGANIZATION_PLACE, "")
        return out

    names = F.transform(F.regexp_extract_all(c, F.lit(rules.ORGANIZATION), F.lit(1)), cleaned)
    found = F.get(F.filter(names, lambda n: (F.length(n) >= 4) & ~n.rlike(rules.ORGANIZATION_VAGUE)), F.lit(0))
    # Few texts have a suffix at all; only these are searched for names.
    return F.when(c.rlike("|".join(rules.ORGANIZATION_SUFFIXES)), found)


def organization(*texts: Column) -> Column:
    return F.coalesce(*(organization_in(t) for t in texts))


@F.pandas_udf(T.StringType())
def _folded(names):
    import unicodedata

    return names.map(lambda n: "".join(unicodedata.normalize("NFKC", n or "").casefold().split()))


def normal_organization(c: Column) -> Column:
    """NFKC, case folded, without blanks and without one legal suffix if something remains."""
    return F.regexp_replace(_folded(or_empty(c)), rf"(?s)^(.+?)(?:{'|'.join(rules.LEGAL_SUFFIXES)})$", "$1")


def issue_family(*texts: Column, families=rules.FAMILIES) -> Column:
    whole = F.concat(*(or_empty(t) for t in texts))
    return first_contained(whole, [(words, name) for name, words in families])


def phone(c: Column) -> Column:
    """Struct (phone_exact, phone_mask_pattern, phone_is_valid)."""
    text = without_blanks(or_empty(c))
    exact = text.rlike(rules.PHONE_EXACT)
    return F.struct(F.when(exact, text).alias("phone_exact"), F.when(~exact & text.rlike(rules.PHONE_MASKED), text).alias("phone_mask_pattern"), exact.alias("phone_is_valid"))


def earlier_orders(c: Column) -> Column:
    """Work order ids named after a context word, distinct, in order."""
    return F.array_distinct(F.regexp_extract_all(or_empty(c), F.lit(rules.EARLIER_ORDER), F.lit(1)))


def occurrences(c: Column) -> Column:
    """kind:ID of orders, then of complaints, distinct, in order."""
    of = lambda kind, p: F.transform(F.regexp_extract_all(or_empty(c), F.lit(p), F.lit(1)), lambda x: F.concat(F.lit(f"{kind}:"), F.upper(F.regexp_replace(x, "[^0-9A-Za-z]", ""))))
    return F.array_distinct(F.concat(*(of(kind, p) for kind, p in rules.OCCURRENCES)))


def issue_segments(c: Column) -> Column:
    """Array of (segment_no, text, label, is_independent); numbers keep the gaps of empty ones."""
    return let(collapse(c), _segments_of)


def first_label(c: Column) -> Column:
    """The label of the first issue segment, null if it has none; only texts with a label are cut."""
    return F.when(F.replace(c, F.lit("\r"), F.lit("")).rlike("事项[一二三四1-4]"), F.get(issue_segments(c), F.lit(0))["label"])


def _segments_of(value: Column) -> Column:
    parts = F.filter(F.split(value, rules.ISSUE_MARK), lambda _, i: i > 0)
    labels = F.regexp_extract_all(value, F.lit(rules.ISSUE_MARK), F.lit(1))
    made = lambda no, text, label: F.struct(no.cast("int").alias("segment_no"), text.alias("text"), none_if_empty(label).alias("label"), F.lit(True).alias("is_independent"))
    numbered = F.transform(F.arrays_zip(parts.alias("text"), labels.alias("label")), lambda x, i: made(i + 1, strip(x["text"]), x["label"]))
    found = F.filter(numbered, lambda s: s["text"] != "")
    alone = F.when(value != "", F.array(made(F.lit(1), value, F.lit("")))).otherwise(F.slice(F.array(made(F.lit(1), value, F.lit(""))), 1, 0))
    return F.when(F.size(labels) > 0, found).otherwise(alone)


def without_place(address: Column, where: Column, way: Column) -> Column:
    """The address without its region and street."""
    return remove_first(remove_first(address, where), way, ("镇", "乡"))


#: Of each component the pattern, and its group. Where the group isn't all of the match, it is
#: taken from the match.
COMPONENTS = {"road": (rules.ROAD_HOUSE, 1), "house_no": (rules.ROAD_HOUSE, 2), "building": (rules.BUILDING, 0), "unit": (rules.UNIT, 0), "room": (rules.ROOM, 0), "shop_no": (rules.SHOP, 1), "floor": (rules.FLOOR, 0)}
PATTERNS = {"road": rules.ROAD_HOUSE, "building": rules.BUILDING, "unit": rules.UNIT, "room": rules.ROOM, "shop_no": rules.SHOP, "floor": rules.FLOOR}


#: Words of which a text that a pattern matches has one; the others need not be searched.
SIGNS = {"road": ("路", "街", "道", "巷"), "building": ("厂房", *rules.BUILDINGS[1:]), "unit": ("单元",), "room": ("室", "房"), "shop_no": ("商铺", "店铺", "铺位"), "floor": (*rules.FLOORS, "F", "f")}


def component_matches(scoped: Column) -> dict[str, Column]:
    """What each pattern matches first, '' if it doesn't; the road with its house number."""

    def found(name: str, pattern: str) -> Column:
        none = ~reduce(lambda a, b: a | b, (F.contains(scoped, F.lit(w)) for w in SIGNS[name]))
        if name == "road":
            none = none | ~scoped.rlike(r"(?U)\d")
        return F.when(none, "").otherwise(F.regexp_extract(scoped, pattern, 0))

    return {name: found(name, p) for name, p in PATTERNS.items()}


def raw_components(matches: dict[str, Column]) -> dict[str, Column]:
    """The address components as written."""
    of = lambda name, group: first_group(matches["road" if name == "house_no" else name], COMPONENTS[name][0], group)
    return {name: of(name, group) if group else none_if_empty(matches[name]) for name, (_, group) in COMPONENTS.items()}


def rest_of(scoped: Column, matches: dict[str, Column]) -> Column:
    """What remains of an address without its components."""
    rest = scoped
    for found in matches.values():
        rest = remove_first(rest, found)
    rest = F.regexp_replace(rest, r"(?U)^[\s,，。:：-]+|[\s,，。:：-]+$", "")
    return strip(F.regexp_replace(rest, r"(?U)^(?:地址|事发地点)\s*[:：]?", ""))


def anchor_type(rest: Column) -> Column:
    return F.when(first_contained(rest, rules.DIRECTIONS).isNotNull(), "landmark").when(rest != "", "subject").otherwise("unknown")


def strip_code_fence(c: Column) -> Column:
    """The inside of a text that is one fenced block, else the text, stripped."""
    bare = strip(or_empty(c))
    return F.regexp_replace(bare, r"(?isU)^```(?:json)?\s*(.*?)\s*```$", "$1")
