"""Text expressions on columns: folding, tokens, normal forms. All stay inside the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocabulary import AGE_CAP, AGE_PENALTY, AGE_UNKNOWN, MONTHS, OBSOLETE_MARK, OBSOLETE_PENALTY


def _stripped(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))


def _folded(c: str) -> str:
    return _stripped(_stripped(c).casefold())


@lru_cache(maxsize=2)
def _table(form: Callable[[str], str]) -> dict[str, str]:
    """What becomes of each character beyond ASCII that the form changes: a rule over all planes in use, not a list. Hangul
    syllables stay composed."""
    codes = (*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x30000))
    return {c: f for c in map(chr, codes) if (f := form(c)) != c}


@lru_cache(maxsize=2)
def _parts(form: Callable[[str], str]) -> tuple[str, str, dict[str, str]]:
    """The table as translate() takes it, what goes at the end, and the characters that become several."""
    table = _table(form)
    one = [c for c, f in table.items() if len(f) == 1]
    gone = [c for c, f in table.items() if not f]
    return "".join(one + gone), "".join(table[c] for c in one), {c: f for c, f in table.items() if len(f) > 1}


_USUAL = "ßẞ…™№½¼¾ﬁﬂﬀﬃﬄ"  # characters of several letters that are looked for first, as a search for each costs little


def _apply(x: Column, form: Callable[[str], str]) -> Column:
    source, target, several = _parts(form)
    pairs = F.str_to_map(F.lit("\x01".join(f"{c}\x02{f}" for c, f in several.items())), F.lit("\x01"), F.lit("\x02"))  # one literal, folded
    spread = lambda t: F.array_join(F.transform(F.split(t, ""), lambda c: F.when(F.octet_length(c) == 1, c).otherwise(F.coalesce(F.try_element_at(pairs, c), c))), "")
    usual = lambda t: reduce(lambda u, c: F.replace(u, F.lit(c), F.lit(several[c])), [c for c in _USUAL if c in several], t)
    held = lambda t: F.length(F.translate(t, "".join(several), "")) < F.length(t)
    whole = lambda t: F.translate(let(usual(t), lambda u: F.when(held(u), spread(u)).otherwise(u)), source, target)
    return let(x, lambda t: F.when(F.octet_length(t) == F.char_length(t), t).otherwise(whole(t)))


def bare(text: str) -> str:
    """strip_accents() for a string."""
    return text.translate(str.maketrans(_table(_stripped)))


def folded(text: str) -> str:
    """fold() for a string."""
    return text.translate(str.maketrans(_table(_folded))).lower()


def column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x worked out once, however often f uses it."""
    return F.get(F.transform(F.array(x), f), 0)


def strip_accents(x: Column | str) -> Column:
    """Compatibility forms without their marks. ASCII texts are passed on as they are."""
    return _apply(column(x), _stripped)


def fold(x: Column | str) -> Column:
    """Compatibility forms without marks and case."""
    return F.lower(_apply(column(x), _folded))


def squeeze(x: Column | str) -> Column:
    """Runs of white space become one space, ends are trimmed."""
    return F.trim(F.regexp_replace(column(x), r"(?U)\s+", " "))


def normal_text(x: Column | str) -> Column:
    return squeeze(fold(x))


def tokens(x: Column | str) -> Column:
    """Runs of letters and digits of the folded text."""
    return F.regexp_extract_all(fold(x), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def token_line(x: Column | str) -> Column:
    """The tokens of a text in one string, each with a space before it, and a space at the end."""
    return F.regexp_replace(F.concat(F.lit(" "), fold(x), F.lit(" ")), r"[^\p{L}\p{N}]+", " ")


def words(x: Column | str) -> Column:
    t = normal_text(x)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def shingles(w: Column, size: int) -> Column:
    """Distinct shingles of a word array; fewer words give one shingle of all, none gives none."""
    n = F.size(w)
    many = F.array_distinct(F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.array_join(F.slice(w, i, F.lit(size)), " ")))
    return F.when(n == 0, F.array().cast("array<string>")).when(n < size, F.array(F.array_join(w, " "))).otherwise(many)


def number_key(raw: Column | str) -> Column:
    """A legal number's key: folded, cut at / - . and space, leading zeros off, joined by /."""
    parts = F.filter(F.split(fold(F.coalesce(column(raw), F.lit(""))), r"[/\-.\s]+"), lambda s: s != "")
    bare = F.transform(parts, lambda s: F.regexp_replace(s, "^0+(?=.)", ""))
    return F.array_join(bare, "/")


def article_tag(raw: Column | str) -> Column:
    """The number as chunks carry it: 1er, 12, 12 bis."""
    x = F.trim(F.regexp_replace(F.lower(column(raw)), r"(?U)[\s-]+", " "))
    one = x.rlike(r"^(premier|1\s*er)$")
    number = F.regexp_extract(x, r"^(\d+)\s*(bis|ter|quater|quinquies|sexies|septies)?$", 1)
    suffix = F.regexp_extract(x, r"^(\d+)\s*(bis|ter|quater|quinquies|sexies|septies)?$", 2)
    plain = F.concat_ws(" ", F.regexp_replace(number, "^0+(?=.)", ""), F.when(suffix != "", suffix))
    return F.when(one, F.lit("1er")).when(number == "", x).otherwise(plain)


def article_key(raw: Column | str) -> Column:
    """The number as the article graph keys it: 1, 12, 12bis."""
    x = F.lower(F.regexp_replace(F.coalesce(column(raw), F.lit("")), r"(?U)[°º\s]+", ""))
    return F.when(x.isin("1er", "premier"), F.lit("1")).otherwise(x)


def french_date(day: Column, month: Column, year: Column) -> Column:
    """ISO text; the calendar is not asked."""
    names = F.array(*[F.lit(folded(m)) for m in MONTHS])
    number = F.array_position(names, fold(month))
    known = (number > 0) & (day != "") & (year != "")
    return F.when(known, F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(number.cast("string"), 2, "0"), F.lpad(day, 2, "0"))).otherwise("")


def legal_year(title: Column, published: Column, as_of_year: int) -> Column:
    """The greatest plausible year of the title, else the first of the date text, if it is plausible."""
    pattern = F.lit(r"\b(19[5-9]\d|20\d{2})\b")
    named = F.filter(F.transform(F.regexp_extract_all(title, pattern, F.lit(1)), lambda y: y.cast("int")), lambda y: y <= as_of_year + 1)
    first = F.regexp_extract(F.coalesce(published, F.lit("")), r"\b(19[5-9]\d|20\d{2})\b", 1)
    other = F.when(first != "", first.cast("int"))
    return F.coalesce(F.array_max(named), F.when(other <= as_of_year + 1, other))


def recency_score(score: Column, title: Column, published: Column, as_of_year: int, per_year: float = AGE_PENALTY, cap: int = AGE_CAP, unknown: int = AGE_UNKNOWN, obsolete: float = OBSOLETE_PENALTY) -> Column:
    """The score (less is better) with a penalty for age and for obsolete texts added."""
    year = legal_year(title, published, as_of_year)
    age = F.when(year.isNull(), F.lit(unknown)).otherwise(F.least(F.greatest(F.lit(as_of_year) - year, F.lit(0)), F.lit(cap)))
    return score + age * F.lit(per_year) + F.when(title.startswith(OBSOLETE_MARK), F.lit(obsolete)).otherwise(F.lit(0.0))


def title_from_stem(name: Column | str) -> Column:
    stem = F.regexp_replace(column(name), r"(?<=.)\.[^.]*$", "")
    spaced = F.trim(F.regexp_replace(F.regexp_replace(stem, "[_-]+", " "), r"(?U)\s+", " "))
    return F.coalesce(F.nullif(spaced, F.lit("")), column(name))


def document_id(relative_path: Column | str) -> Column:
    return F.substring(F.sha2(F.lower(column(relative_path)), 256), 1, 20)


def file_key(value: Column | str) -> Column:
    """The base name by which catalogue rows and files meet."""
    return F.lower(F.trim(F.element_at(F.split(F.translate(column(value), "\\", "/"), "/"), -1)))


def safe_filename(value: Column | str, limit: int = 72) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(column(value), "[^A-Za-z0-9._-]+", "_"), "^[._]+|[._]+$", ""), 1, limit)


def conversation_title(question: Column | str, limit: int = 100, default: str = "Nouvelle conversation") -> Column:
    return F.coalesce(F.nullif(F.substring(squeeze(question), 1, limit), F.lit("")), F.lit(default))


def first_value(*fields: Column) -> Column:
    """The first field that is not blank, else the empty string."""
    return F.coalesce(*[F.nullif(F.trim(f), F.lit("")) for f in fields], F.lit(""))
