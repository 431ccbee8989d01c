"""Person names: normal form, script, parts, matching. Column functions, and a parsed form for sequential folds."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
CERTIFIED = r"\(\s*(?:인|서명|signature|seal)\s*\)"
SYLLABLE, HANZI, LETTER = "[가-힣]", "[㐀-䶿一-鿿]", "[A-Za-z]"
SPACES = "[\\s 　]+"


# Combining marks of names, and the letters that they make with a letter before them.
MARKS = "[\u0300-\u036f]"
COMPOSED = {d: chr(c) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)] if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and unicodedata.normalize("NFC", d) == chr(c)}
PAIRS = {(unicodedata.normalize("NFC", d[:-1]) + d[-1]): c for d, c in COMPOSED.items()}
LEADS, VOWELS, TAILS = "[\u1100-\u1112]", "[\u1161-\u1175]", "[\u11a8-\u11c2]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once and the plan holding it once."""
    return F.get(F.transform(F.array(value), use), 0)


def nfc(name: Column | str) -> Column:
    """Composed Unicode form of Hangul parts and of Latin letters with marks; other scripts' marks stay as they are."""
    return let(F.col(name) if isinstance(name, str) else name, _composed)


def _composed(s: Column) -> Column:
    code = lambda c, i: F.ascii(F.substring(c, i, 1))
    letter = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 4, F.lit("0"))), "UTF-16BE")

    def syllable(t: Column) -> Column:
        tail = lambda i: F.when(F.length(t) >= i, code(t, i) - 0x11A7).otherwise(0)
        parts = 44032 + (code(t, 1) - 0x1100) * 588 + (code(t, 2) - 0x1161) * 28 + tail(3)
        late = code(t, 1) + tail(2)  # a whole syllable and a tail behind it
        return F.when(t.rlike(f"^{LEADS}{VOWELS}"), letter(parts)).when(t.rlike(f"^{SYLLABLE}{TAILS}$") & ((code(t, 1) - 44032) % 28 == 0), letter(late)).otherwise(t)

    each = lambda text, p, f: F.array_join(F.transform(F.regexp_extract_all(text, F.lit(f"(?s)({p}|.)"), 1), f), "")
    known = F.from_json(F.lit(json.dumps(PAIRS)), "map<string,string>")  # folded to a constant
    marked = lambda text: each(text, f".{MARKS}", lambda t: F.when(F.length(t) == 2, F.coalesce(F.try_element_at(known, t), t)).otherwise(t))
    korean = F.when(s.rlike(f"{VOWELS}|{TAILS}"), each(s, f"{LEADS}{VOWELS}{TAILS}?|{SYLLABLE}{TAILS}", syllable)).otherwise(s)
    return F.when(s.rlike(MARKS), marked(marked(korean))).otherwise(korean)


def normalize(name: Column) -> Column:
    """Composed, blanks collapsed, certification marks removed, syllables spelled apart joined. Null gives ''."""
    s = F.trim(F.regexp_replace(nfc(F.coalesce(name, F.lit(""))), SPACES, " "))
    s = F.trim(F.regexp_replace(F.regexp_replace(s, f"(?i){CERTIFIED}", ""), " +", " "))
    return let(s, lambda t: F.when(t.rlike(f"^{SYLLABLE}( {SYLLABLE})+$"), F.replace(t, F.lit(" "), F.lit(""))).otherwise(t))


def script(norm: Column) -> Column:
    marks = [("korean", SYLLABLE), ("han", HANZI), ("latin", LETTER)]
    n = sum((norm.rlike(p).cast("int") for _, p in marks[1:]), norm.rlike(SYLLABLE).cast("int"))
    one = F.when(n == 0, "unknown").when(n > 1, "mixed")
    for label, p in marks:
        one = one.when(norm.rlike(p), label)
    return one


def is_initials(token: Column) -> Column:
    return F.regexp_replace(token, r"\.", "").rlike("^[A-Z]{1,3}$")


def parts(norm: Column) -> Column:
    """Struct of surname, given (tokens), first (first given name with a letter) and initial, of a Latin name."""
    tokens = F.filter(F.split(norm, " +"), lambda t: t != "")
    n, last = F.size(tokens), F.try_element_at(tokens, F.lit(-1))
    comma = norm.contains(",")
    after = F.filter(F.split(F.trim(F.regexp_replace(norm, "^[^,]*,", "")), " +"), lambda t: t != "")
    none = F.array().cast("array<string>")
    surname = F.when(comma, F.nullif(F.trim(F.substring_index(norm, ",", 1)), F.lit(""))).when(n > 0, F.when(~is_initials(last), last))
    given = F.when(comma, after).when(n == 0, none).when(is_initials(last), tokens).when(n == 1, none).otherwise(F.slice(tokens, 1, F.greatest(n - 1, F.lit(0))))
    first = F.get(F.filter(given, lambda t: t.rlike(LETTER)), 0)
    return F.struct(surname.alias("surname"), given.alias("given"), first.alias("first"), F.upper(F.substring(F.replace(first, F.lit("."), F.lit("")), 1, 1)).alias("initial"))


def key(name: Column) -> Column:
    """Blocking key: equal keys are candidates, and so are equal lower-cased normal forms."""
    return let(normalize(name), _key)


def _key(norm: Column) -> Column:
    kind, p, whole = script(norm), parts(norm), F.lower(norm)
    return (
        F.when(kind.isin("korean", "han"), F.concat(kind, F.lit(":"), F.replace(norm, F.lit(" "), F.lit(""))))
        .when((kind == "latin") & p.surname.isNotNull() & p.initial.isNotNull(), F.concat(F.lit("latin:"), F.lower(p.initial), F.lit(" "), F.lower(p.surname)))
        .when(kind == "latin", F.concat(F.lit("latin-raw:"), whole))
        .otherwise(F.concat(F.lit("raw:"), whole))
    )


def initials_form(name: Column) -> Column:
    return let(normalize(name), lambda norm: let(parts(norm), _short_form))


def _short_form(p: Column) -> Column:
    return F.when(p.surname.isNotNull() & p.initial.isNotNull(), F.concat(p.initial, F.lit(" "), F.upper(F.substring(p.surname, 1, 1)), F.regexp_replace(p.surname, "^.", "")))


def completeness(name: Column) -> Column:
    """3 full, 2 surname and initial, 1 ambiguous."""
    return let(normalize(name), _completeness)


def _completeness(norm: Column) -> Column:
    kind, p = script(norm), parts(norm)
    spelled = F.exists(p.given, lambda t: ~is_initials(t) & t.rlike("[a-z]"))
    compact = F.length(F.replace(norm, F.lit(" "), F.lit("")))
    return F.when(kind.isin("korean", "han"), F.when(compact >= 2, 3).otherwise(1)).when(kind == "latin", F.when(p.surname.isNull(), 1).when(spelled, 3).otherwise(2)).otherwise(1)


def parsed(name: Column) -> Column:
    """What matching needs of a raw name, computed once a row: struct of norm, script, surname, initial, first and full."""
    made = lambda norm, p: F.struct(norm.alias("norm"), script(norm).alias("script"), F.lower(p["surname"]).alias("surname"), p["initial"].alias("initial"), F.lower(p["first"]).alias("first"), (~is_initials(p["first"])).alias("full"))
    return let(normalize(name), lambda norm: let(parts(norm), lambda p: made(norm, p)))


def same(x: Column, y: Column) -> Column:
    """Confident match of two parsed names; not transitive."""
    bare = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    near = (x["surname"] == y["surname"]) & (x["initial"] == y["initial"]) & (~(x["full"] & y["full"]) | (x["first"] == y["first"]))
    latin = (F.lower(x["norm"]) == F.lower(y["norm"])) | F.coalesce(near, F.lit(False))
    return (
        F.when((x["norm"] == "") | (y["norm"] == ""), False).when(x["norm"] == y["norm"], True).when(x["script"] != y["script"], False)
        .when(x["script"].isin("korean", "han"), bare(x["norm"]) == bare(y["norm"])).when(x["script"] == "latin", latin).otherwise(False)
    )


def matches(a: Column, b: Column) -> Column:
    """Confident match of two raw names; not transitive."""
    return let(F.struct(parsed(a).alias("a"), parsed(b).alias("b")), lambda x: same(x["a"], x["b"]))


def jamo(name: Column) -> Column:
    """Each Hangul syllable as two or three ASCII letters, one for each of its parts; other characters as they are."""
    def one(c: Column) -> Column:
        n = F.ascii(c) - 44032
        tail = F.when(n % 28 > 0, F.char(73 + n % 28)).otherwise("")
        return F.when(c.rlike(SYLLABLE), F.concat(F.char(33 + F.floor(n / 588)), F.char(52 + F.floor(n % 588 / 28)), tail)).otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(name, ""), lambda c: c != ""), one), "")


def jamo_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(jamo(a), jamo(b))


def near_duplicate(a: Column, b: Column) -> Column:
    """'misread', 'abbrev' or null, of two Korean names without blanks."""
    hangul = a.rlike(f"^{SYLLABLE}+$") & b.rlike(f"^{SYLLABLE}+$") & (a != b) & (F.substring(a, 1, 1) == F.substring(b, 1, 1))
    gap = F.length(a) - F.length(b)
    prefix = F.when(gap == 1, (F.length(b) >= 2) & a.startswith(b)).when(gap == -1, (F.length(a) >= 2) & b.startswith(a))
    return F.when(hangul & (gap == 0) & (jamo_distance(a, b) == 1), "misread").when(hangul & prefix, "abbrev")


# ---- the parsed form, for folds in which order matters


@dataclass(frozen=True)
class Name:
    norm: str
    script: str
    surname: str | None
    given: tuple[str, ...]
    first: str | None

    @property
    def compact(self) -> str:
        return re.sub(r"\s+", "", self.norm)

    @property
    def initial(self) -> str | None:
        return self.first.replace(".", "")[:1].upper() if self.first else None

    @property
    def completeness(self) -> int:
        if self.script in ("korean", "han"):
            return 3 if len(self.compact) >= 2 else 1
        if self.script != "latin" or not self.surname:
            return 1
        return 3 if any(not short(t) and re.search("[a-z]", t) for t in self.given) else 2

    def same(self, other: Name) -> bool:
        if not self.norm or not other.norm:
            return False
        if self.norm == other.norm:
            return True
        if self.script != other.script or self.script in ("mixed", "unknown"):
            return False
        if self.script != "latin":
            return self.compact == other.compact
        if self.norm.lower() == other.norm.lower():
            return True
        if not (self.surname and other.surname and self.initial) or (self.surname.lower(), self.initial) != (other.surname.lower(), other.initial):
            return False
        return short(self.first) or short(other.first) or self.first.lower() == other.first.lower()


def short(token: str) -> bool:
    return re.fullmatch("[A-Z]{1,3}", token.replace(".", "")) is not None


@lru_cache(100_000)
def parse(raw: str | None) -> Name:
    s = re.sub(r"\s+", " ", unicodedata.normalize("NFC", raw or "")).strip()
    s = re.sub(r"\s+", " ", re.sub(CERTIFIED, "", s, flags=re.I)).strip()
    if re.fullmatch(f"{SYLLABLE}(?: {SYLLABLE})+", s):
        s = s.replace(" ", "")
    kinds = [k for k, p in (("korean", SYLLABLE), ("han", HANZI), ("latin", LETTER)) if re.search(p, s)]
    kind = kinds[0] if len(kinds) == 1 else "mixed" if kinds else "unknown"
    if "," in s:
        head, _, tail = s.partition(",")
        surname, given = head.strip() or None, tail.split()
    else:
        tokens = s.split()
        named = bool(tokens) and not short(tokens[-1])
        surname, given = (tokens[-1], tokens[:-1]) if named else (None, tokens)
    return Name(s, kind, surname, tuple(given), next((t for t in given if re.search(LETTER, t)), None))
