"""Addresses and names as Column expressions: cleaning, spelling out, keys, tokens and codes."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts that say nothing, short forms with what they stand for, and the other word lists of the address rules.
JUNK_PARTS = ("n/a", "na", "n.a", "n.a.", "-", ".", "none", "unknown")
ABBREVIATIONS = {
    "rd": "road", "ave": "avenue", "av": "avenue", "sq": "square", "pk": "park", "dr": "drive", "tce": "terrace", "terr": "terrace", "cres": "crescent",
    "cresc": "crescent", "ct": "court", "crt": "court", "gdns": "gardens", "grn": "green", "hts": "heights", "lwr": "lower", "upr": "upper", "est": "estate",
    "mt": "mount", "cl": "close", "cotts": "cottages", "apt": "apartment", "appartment": "apartment", "app": "apartment", "apts": "apartments", "blk": "block",
}
STREET_QUALIFIERS = ("lower", "upper", "north", "south", "east", "west", "little", "great")
LOWER_WORDS = ("of", "the", "and", "on", "at", "in", "na", "an", "de", "le", "ná", "upon")
NAME_FILLER = ("the", "saint", "of")
DIVISIONS = ("big", "little", "more", "beg", "upper", "lower", "north", "south", "east", "west", "middle", "great")
DISTRICTS = (*map(str, range(1, 19)), "20", "22", "24", "6w")
EIRCODE = "^(?:[AC-FHKNPRTV-Y][0-9]{2}|D6W)[0-9AC-FHKNPRTV-Y]{4}$"
HOUSE_NUMBER = "^[0-9]+[a-z]?(?:-[0-9]+[a-z]?)?$"
UNIT = "^((?:apartment|flat|unit|suite) (?:[a-z]?[0-9]+[a-z]?|[a-z])(?: block (?:[a-z]?[0-9]+[a-z]?|[a-z]))?)(?: |$)"
BLOCK = "^block (?:[a-z]?[0-9]+[a-z]?|[a-z])$"
ACCENTS = ("áàâäãåçéèêëíìîïñóòôöõúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def let(x: Column, use) -> Column:
    """``use(x)`` with ``x`` worked out once: a bound variable, for values that lambdas read again and again."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def squeeze(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def fold(x: Column) -> Column:
    """Lower case without accents; lower case first, so that one table serves both cases."""
    return F.translate(F.lower(x), *ACCENTS)


def parts(raw: Column) -> Column:
    """Comma parts without outer blanks and dots; parts that say nothing go."""
    cut = F.transform(F.split(squeeze(raw), ","), lambda p: F.regexp_replace(p, r"^[ .]+|[ .]+$", ""))
    return F.filter(cut, lambda p: (p != "") & ~F.lower(p).isin(*JUNK_PARTS))


def _capital(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(x.substr(F.lit(2), F.char_length(x))))


def title_word(word: Column) -> Column:
    """One word in title case: codes in capitals, O'Brien but James's, McCann, hyphenated halves."""
    head = F.substring_index(word, "'", 1)
    tail = word.substr(F.char_length(head) + 2, F.char_length(word))
    apostrophe = F.concat(_capital(head), F.lit("'"), F.when((F.char_length(head) == 1) & (F.char_length(tail) > 1), _capital(tail)).otherwise(F.lower(tail)))
    mac = F.concat(F.lit("Mc"), _capital(word.substr(F.lit(3), F.char_length(word))))
    plain = F.array_join(F.transform(F.split(word, "-"), _capital), "-")
    return (
        F.when(word.rlike("[0-9]"), F.upper(word))
        .when(F.contains(word, F.lit("'")), apostrophe)
        .when(F.lower(word).startswith("mc") & (F.char_length(word) > 2), mac)
        .otherwise(plain)
    )


def _title_part(part: Column) -> Column:
    def titled(words: Column) -> Column:
        def one(w: Column, i: Column) -> Column:
            small = (i > 0) & F.lower(w).isin(*LOWER_WORDS) & F.get(words, i - 1).rlike(r"^\p{L}+$")
            return F.when(small, F.lower(w)).otherwise(title_word(w))

        return F.array_join(F.transform(words, one), " ")

    return let(F.split(part, " "), titled)


def display(raw: Column) -> Column:
    """The cleaned address as shown: title case only where the filer wrote no lower-case letter."""
    cleaned = parts(raw)
    joined = F.array_join(cleaned, ", ")
    shown = F.when(joined.rlike(r"\p{Ll}"), joined).otherwise(F.array_join(F.transform(cleaned, _title_part), ", "))
    return F.when(F.size(cleaned) > 0, shown).otherwise(squeeze(raw))


def _street_or_saint(before: Column, after: Column) -> Column:
    """"st" stands for a saint only where a name begins, and not before a word such as "lower"."""
    begins = before.isNull() | before.rlike(HOUSE_NUMBER)
    return F.when(begins & after.isNotNull() & ~after.isin(*STREET_QUALIFIERS), "saint").otherwise("street")


def _spelt(word: Column) -> Column:
    table = F.create_map(*map(F.lit, chain.from_iterable(ABBREVIATIONS.items())))
    return F.coalesce(F.try_element_at(table, word), word)


def expand_part(part: Column, counties: tuple[str, ...]) -> Column:
    """The words of a part in lower case, short forms spelt out."""
    text = F.regexp_replace(F.lower(part), r"\b(apt|flat|unit)([0-9]+[a-z]?)\b", "$1 $2")
    found = F.filter(F.transform(F.split(squeeze(F.regexp_replace(text, r"\.", ". ")), " "), lambda w: F.regexp_replace(w, r"\.+$", "")), lambda w: w != "")

    def spelt(words: Column) -> Column:
        def one(w: Column, i: Column) -> Column:
            before, after = F.get(words, i - 1), F.get(words, i + 1)
            dropped = w.isin("no", "number") & after.rlike("^[0-9]")
            return (
                F.when(F.coalesce(dropped, F.lit(False)), F.lit(""))
                .when((w == "county") & F.coalesce(after.isin(*counties), F.lit(False)), "co")
                .when(w == "st", _street_or_saint(before, after))
                .otherwise(_spelt(w))
            )

        return F.array_join(F.filter(F.transform(words, one), lambda w: w != ""), " ")

    return let(found, spelt)


def expanded(raw: Column, counties: tuple[str, ...]) -> Column:
    return F.filter(F.transform(parts(raw), lambda p: expand_part(p, counties)), lambda p: p != "")


def normalised(raw: Column, counties: tuple[str, ...]) -> Column:
    return F.array_join(expanded(raw, counties), ", ")


def without_county(found: Column, county: Column) -> Column:
    """Expanded parts without "co X" at the end of the last, or a last part that only names the county."""
    last, head = F.get(found, F.size(found) - 1), F.slice(found, F.lit(1), F.greatest(F.size(found) - 1, F.lit(0)))
    stem = F.rtrim(last.substr(F.lit(1), F.greatest(F.char_length(last) - F.char_length(county) - 3, F.lit(0))))
    ends = (last == F.concat(F.lit("co "), county)) | last.endswith(F.concat(F.lit(" co "), county))
    return (
        F.when(F.size(found) == 0, found)
        .when(ends, F.when(stem == "", head).otherwise(F.concat(head, F.array(stem))))
        .when((last == county) & (F.size(found) > 1), head)
        .otherwise(found)
    )


def unit_of(found: Column) -> Column:
    """"apartment 5 block a" at the front of the first part (the block may be the second part), else null."""
    unit = F.regexp_extract(F.coalesce(F.get(found, F.lit(0)), F.lit("")), UNIT, 1)
    whole = F.get(found, F.lit(0)) == unit
    block = F.coalesce(whole & F.get(found, F.lit(1)).rlike(BLOCK), F.lit(False)) & ~unit.contains(" block ")
    return F.when(unit != "", F.when(block, F.concat_ws(" ", unit, F.get(found, F.lit(1)))).otherwise(unit))


def without_unit(found: Column) -> Column:
    unit = unit_of(found)
    first = F.get(found, F.lit(0))
    own = F.regexp_extract(F.coalesce(first, F.lit("")), UNIT, 1)
    rest = F.trim(first.substr(F.char_length(own) + 1, F.char_length(first)))
    tail = F.slice(found, F.lit(2), F.size(found))
    skip = F.char_length(unit) > F.char_length(own)
    return F.when(unit.isNull() | (F.size(found) == 0), found).when(skip, F.slice(found, F.lit(3), F.size(found))).when(rest == "", tail).otherwise(F.concat(F.array(rest), tail))


def key_of(found: Column) -> Column:
    """Letters and digits only; a hyphen stays between two numbers, so that "1 25" is not "125"."""
    text = F.regexp_replace(fold(F.array_join(found, " ")), "([0-9])[^a-z0-9]+(?=[0-9])", "$1\u0001")
    return F.translate(F.regexp_replace(text, "[^a-z0-9\u0001]+", ""), "\u0001", "-")


def house_number(found: Column) -> Column:
    word = F.substring_index(F.get(found, F.lit(0)), " ", 1)
    return F.when(word.rlike(HOUSE_NUMBER), word)


def city_district(text: Column, county: Column, city: str = "dublin") -> Column:
    """"D6W" for a postal district that the city has."""
    n = F.regexp_extract(text, rf"\b{city} ([0-9]{{1,2}}w?)\b", 1)
    return F.when((county == city) & n.isin(*DISTRICTS), F.concat(F.lit("D"), F.upper(n)))


def eircode(raw: Column) -> Column:
    code = F.upper(F.regexp_replace(raw, r"\s+", ""))
    return F.when(code.rlike(EIRCODE), code)


def district_of_eircode(code: Column) -> Column:
    key = F.substring(code, 1, 3)
    n = F.regexp_extract(key, "^D([0-9]{2})$", 1)
    number = F.regexp_replace(n, "^0", "")
    return F.when(key == "D6W", "D6W").when((n != "") & number.isin(*DISTRICTS), F.concat(F.lit("D"), number))


def street_parts(address: Column) -> Column:
    """The parts of an address that may name a street or estate: not the last, without number or unit, no county and no postal district."""
    split = F.split(address, ",")
    cut = F.slice(split, F.lit(1), F.size(split) - 1)
    bare = F.transform(cut, lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"^\s*((apt|apartment|unit|flat|no)\.?\s*)?[0-9][0-9a-z/-]*\s*", ""), r"\s+(dublin|bhaile [aá]tha cliath) ?[0-9]{1,2}w?$", "")))
    return F.filter(bare, lambda p: (p != "") & ~p.rlike(r"^([0-9]|(co\.?|county) |(dublin|d|bhaile [aá]tha cliath) ?[0-9]{1,2}w?$)"))


def name_tokens(name: Column) -> Column:
    """The sorted set of a name's telling words: folded, spelt out, without numbers and filler."""
    text = F.regexp_replace(fold(name), "'s\\b|['\u2019]", "")

    def spelt(words: Column) -> Column:
        return F.transform(words, lambda w, i: F.when(w == "st", _street_or_saint(F.get(words, i - 1), F.get(words, i + 1))).otherwise(_spelt(w)))

    found = let(F.filter(F.split(text, "[^a-z0-9]+"), lambda w: w != ""), spelt)
    return F.array_sort(F.array_distinct(F.filter(found, lambda w: ~w.isin(*NAME_FILLER, "no") & ~w.rlike(HOUSE_NUMBER))))


def names_match(wanted: Column, got: Column) -> Column:
    """The same tokens, or more of them by words such as "upper" only."""
    more = F.array_except(got, wanted)
    covered = F.size(F.array_except(wanted, got)) == 0
    return (F.size(wanted) > 0) & covered & F.forall(more, lambda w: w.isin(*DIVISIONS))


def deletions(word: Column) -> Column:
    """The word with one letter deleted, for every letter."""
    n = F.char_length(word)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(word.substr(F.lit(1), i - 1), word.substr(i + 1, n)))


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def area_slug(kind: Column, code: Column, name: Column) -> Column:
    """A county's code; a small area's name; other names with their kind before and a digest of their code behind, since names repeat."""
    before = F.when(kind == "electoral_division", "ed-").when(kind == "townland", "townland-").otherwise("")
    return F.when(kind == "county", code).when(kind == "small_area", F.concat(F.lit("sa-"), slug(name))).otherwise(F.concat(before, slug(name), F.lit("-"), F.substring(F.sha1(code), 1, 6)))


def area_name(name: Column) -> Column:
    """Names in capitals (four fifths of the letters or more) in title case."""
    letters, capitals = F.char_length(F.regexp_replace(name, r"\P{L}", "")), F.char_length(F.regexp_replace(name, r"\P{Lu}", ""))
    return F.when((letters > 0) & (capitals * 5 >= letters * 4), _title_part(name)).otherwise(name)


def base32(hexed: Column, chars: int) -> Column:
    """The first letters of a digest in base 32: its hexadecimal digits as bits, five to a letter."""
    digits = -(-chars * 5 // 4)
    bits = F.concat(*(F.lpad(F.conv(F.substring(hexed, i + 1, 1), 16, 2), 4, "0") for i in range(digits)))
    alphabet = F.lit("abcdefghijklmnopqrstuvwxyz234567")
    return F.concat(*(alphabet.substr(F.conv(F.substring(bits, i * 5 + 1, 5), 2, 10).cast("int") + 1, F.lit(1)) for i in range(chars)))


def public_id(county: Column, key: Column, unit: Column) -> Column:
    return base32(F.sha2(F.concat_ws("|", county, key, F.coalesce(unit, F.lit(""))), 256), 12)


def lenient_number(x: Column) -> Column:
    """A plain number, else null."""
    return F.when(x.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), x.cast("double"))


def lenient_date(x: Column) -> Column:
    """A calendar day written yyyy-mm-dd, else null (the 31st of February too)."""
    return F.when(x.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(x, "yyyy-MM-dd"))


def lenient_flag(x: Column, otherwise: bool) -> Column:
    return F.when(F.lower(x) == "true", True).when(F.lower(x) == "false", False).otherwise(otherwise)


#: How surely a property is placed, best first; the last is never asked for.
CONFIDENCES = ("exact", "street", "locality", "routing_key", "county")


def lenient_confidence(x: Column, otherwise: str = "locality") -> Column:
    return F.when(x.isin(*CONFIDENCES), x).otherwise(otherwise)


def lenient_list(x: Column) -> Column:
    """The words between commas, trimmed; null if there are none."""
    words = F.filter(F.transform(F.split(x, ","), lambda w: F.trim(w)), lambda w: w != "")
    return F.when(F.size(words) > 0, words)


def lenient_point(x: Column) -> Column:
    """``longitude,latitude`` in plain numbers within their ranges as (lon, lat), else null."""
    parts = F.split(x, ",")
    number = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    good = x.rlike(r"^-?[0-9]{1,3}(\.[0-9]+)?,-?[0-9]{1,2}(\.[0-9]+)?$") & (F.abs(number(0)) <= 180) & (F.abs(number(1)) <= 90)
    return F.when(good, F.struct(number(0).alias("lon"), number(1).alias("lat")))


def csv_safe(x: Column) -> Column:
    """Text that a spreadsheet would run as a formula gets an apostrophe in front."""
    return F.when(x.rlike("^[=+\\-@\\t\\r]"), F.concat(F.lit("'"), x)).otherwise(x)
