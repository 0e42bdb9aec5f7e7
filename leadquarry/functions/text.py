"""Normalisers for names, phones, web hosts and registry ids, as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: results depend on these exact entries -------------------------------
LEGAL_FORMS = [
    "sarl", "suarl", "sarlu", "sa", "snc", "scs", "sca", "spa", "suar",
    "ste", "societe", "soc", "ets", "etablissement", "etablissements",
    "entreprise", "entreprises", "groupe", "group", "cie", "co", "company",
    "llc", "ltd", "inc", "gmbh",
]
SOCIAL_HOSTS = [
    "facebook.com", "instagram.com", "linkedin.com", "twitter.com", "youtube.com", "tiktok.com",
]
NULL_TOKENS = ["#N/A", "N/A", ""]
# ---------------------------------------------------------------------------------------

# The same text works for Java regex and RE2: Unicode blanks, and "neither word nor blank".
BLANK = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"
NOT_WORD = r"[^\p{L}\p{N}_\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"

# Letters that fold to more than one ASCII letter.
WIDE_FOLDS = [("ß", "ss"), ("ẞ", "SS"), ("œ", "oe"), ("Œ", "OE"), ("æ", "ae"), ("Æ", "AE"),
              ("þ", "th"), ("Þ", "TH")]


def _latin_fold() -> tuple[str, str]:
    """Two aligned strings for ``translate``: every Latin letter whose base is one ASCII sign."""
    source, target = [], []
    for code in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        ch = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if len(base) == 1 and base.isascii() and base.isalnum():
            source.append(ch)
            target.append(base)
    for ch, base in zip("øØđĐłŁıħĦŧŦ", "oOdDlLihHtT"):
        source.append(ch)
        target.append(base)
    return "".join(source), "".join(target)


FOLD_FROM, FOLD_TO = _latin_fold()


def fold_accents(c: Column) -> Column:
    """Latin letters to ASCII; combining marks removed.  Texts of ASCII alone are left as they are."""
    plain = c
    for wide, ascii_form in WIDE_FOLDS:
        c = F.replace(c, F.lit(wide), F.lit(ascii_form))
    folded = F.regexp_replace(F.translate(c, FOLD_FROM, FOLD_TO), r"\p{Mn}+", "")
    return F.when(plain.rlike(r"[^\x00-\x7F]"), folded).otherwise(plain)


def strip_blank(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def raw_tokens(name: Column) -> Column:
    """Lower-case, accent-free word tokens of a name (null name: empty array)."""
    s = F.lower(fold_accents(F.coalesce(name, F.lit(""))))
    s = F.regexp_replace(F.regexp_replace(s, NOT_WORD, " "), f"{BLANK}+", " ")
    return F.filter(F.split(s, " "), lambda t: t != "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _is_initial(t: Column) -> Column:
    return (F.length(t) == 1) & t.rlike(r"^\p{L}$")


def normalized_name(name: Column) -> Column:
    """The matching key: words left after legal forms, codes and single letters are dropped.

    A name made only of initials becomes the joined initials, unless those spell a legal form.
    """
    return _let(raw_tokens(name), _kept_words)


def _kept_words(raw: Column) -> Column:
    words = F.filter(
        raw, lambda t: ~t.isin(LEGAL_FORMS) & ~t.rlike(r"\p{Nd}") & ~_is_initial(t)
    )
    initials = F.array_join(F.filter(raw, _is_initial), "")
    spelled = _let(initials, lambda i: F.when(i.isin(LEGAL_FORMS), F.lit("")).otherwise(i))
    return _let(F.array_join(words, " "), lambda w: F.when(w != "", w).otherwise(spelled))  # tokens are not empty


def has_legal_form(name: Column) -> Column:
    return F.exists(raw_tokens(name), lambda t: t.isin(LEGAL_FORMS))


def normalized_phone(phone: Column, country: str = "216", digits: int = 8,
                     leading: str = "234579", strip_plain_00: bool = False) -> Column:
    """National number without the country code, ``""`` when it is not a valid one.

    ``strip_plain_00`` also accepts a bare ``00`` prefix.
    """
    d = F.regexp_replace(F.coalesce(phone, F.lit("")), r"\P{Nd}", "")
    n = len(country)
    local = (
        F.when(d.startswith("00" + country), F.substr(d, F.lit(n + 3)))
        .when(d.startswith(country) & (F.length(d) >= n + digits), F.substr(d, F.lit(n + 1)))
    )
    if strip_plain_00:
        local = local.when(d.startswith("00") & (F.length(d) == digits + 2), F.substr(d, F.lit(3)))
    local = local.otherwise(d)
    return F.when(local.rlike(rf"^[{leading}]\p{{Nd}}{{{digits - 1}}}$"), local).otherwise("")


def normalized_host(url: Column) -> Column:
    """Host (sub-domain and port kept) of a web address; null or blank gives ``""``."""
    u = F.lower(strip_blank(F.coalesce(url, F.lit(""))))
    u = F.regexp_replace(F.regexp_replace(u, r"^https?://", ""), r"^www\.", "")
    return strip_blank(F.substring_index(F.substring_index(u, "/", 1), "?", 1))


def is_social_host(host: Column) -> Column:
    return host.isin(SOCIAL_HOSTS)


def normalized_registry_id(rne: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(rne, F.lit("")), f"{BLANK}+", ""))


def null_if_token(c: Column) -> Column:
    """``#N/A``, ``N/A`` and the empty string read as null."""
    return F.when(~c.isin(NULL_TOKENS), c)


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip_blank(c) == "")
