"""Steps on articles that the pipeline describes without fixing them; the parameters are ours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEDE_CHARS = 200
#: Unicode's space separators, which TRIM takes off a line.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: Letters and digits of Unicode 14 and 15, which Java 17 does not know as such.
_LATER = (
    r"\x{870}-\x{887}\x{889}-\x{88E}\x{8B5}\x{8C8}-\x{8C9}\x{C5D}\x{CDD}\x{170D}\x{171F}\x{1B4C}\x{2C2F}\x{2C5F}\x{9FFD}-\x{9FFF}\x{A7C0}-\x{A7C1}"
    r"\x{A7D0}-\x{A7D1}\x{A7D3}\x{A7D5}-\x{A7D9}\x{A7F2}-\x{A7F4}\x{10570}-\x{1057A}\x{1057C}-\x{1058A}\x{1058C}-\x{10592}\x{10594}-\x{10595}"
    r"\x{10597}-\x{105A1}\x{105A3}-\x{105B1}\x{105B3}-\x{105B9}\x{105BB}-\x{105BC}\x{10780}-\x{10785}\x{10787}-\x{107B0}\x{107B2}-\x{107BA}"
    r"\x{10F70}-\x{10F81}\x{11071}-\x{11072}\x{11075}\x{1123F}-\x{11240}\x{11740}-\x{11746}\x{11AB0}-\x{11ABF}\x{11F02}\x{11F04}-\x{11F10}"
    r"\x{11F12}-\x{11F33}\x{11F50}-\x{11F59}\x{12F90}-\x{12FF0}\x{1342F}\x{13441}-\x{13446}\x{16A70}-\x{16ABE}\x{16AC0}-\x{16AC9}\x{1AFF0}-\x{1AFF3}"
    r"\x{1AFF5}-\x{1AFFB}\x{1AFFD}-\x{1AFFE}\x{1B11F}-\x{1B122}\x{1B132}\x{1B155}\x{1D2C0}-\x{1D2D3}\x{1DF00}-\x{1DF1E}\x{1DF25}-\x{1DF2A}"
    r"\x{1E030}-\x{1E06D}\x{1E290}-\x{1E2AD}\x{1E4D0}-\x{1E4EB}\x{1E4F0}-\x{1E4F9}\x{1E7E0}-\x{1E7E6}\x{1E7E8}-\x{1E7EB}\x{1E7ED}-\x{1E7EE}"
    r"\x{1E7F0}-\x{1E7FE}\x{2A6DE}-\x{2A6DF}\x{2B735}-\x{2B739}\x{31350}-\x{323AF}"
)
#: Query parameters that only track readers.
TRACKING = r"(?:utm_[a-z]+|fbclid|gclid|ref)"
#: Frequent words by language, for a vote.
STOPWORDS = {"de": ("der", "die", "und", "das", "von", "ist"), "en": ("the", "of", "and", "to", "in", "is"), "es": ("el", "los", "una", "que", "por", "para"), "fr": ("le", "les", "et", "est", "des", "pour")}


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no fragment, no tracking parameters, no slash at the end."""
    out = F.regexp_replace(F.trim(url), "#.*$", "")
    out = F.regexp_replace(out, rf"([?&]){TRACKING}=[^&]*(?=&|$)", "$1")
    out = F.regexp_replace(F.regexp_replace(out, "[?&]+$", ""), r"([?&])&+", "$1")
    host = F.regexp_extract(out, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", 0)
    return F.regexp_replace(F.concat(F.lower(host), F.substr(out, F.length(host) + 1)), "/+$", "")


def lede(text: Column) -> Column:
    """The first line with a letter or digit, without spaces around it, cut to LEDE_CHARS characters; NULL without one."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x, F.lit(SPACES))), lambda x: x.rlike(rf"[\p{{L}}\p{{N}}{_LATER}]"))
    return F.left(F.get(lines, 0), F.lit(LEDE_CHARS))


def language(text: Column) -> Column:
    """The language whose frequent words occur most often, ties by name; NULL without any."""
    words = F.split(F.lower(text), r"[^\p{L}]+")

    def vote(rank: int, name: str, known: tuple[str, ...]) -> Column:
        return F.struct(F.size(F.filter(words, lambda w: w.isin(*known))).alias("n"), F.lit(-rank).alias("rank"), F.lit(name).alias("name"))

    votes = F.array(*[vote(rank, name, known) for rank, (name, known) in enumerate(sorted(STOPWORDS.items()))])
    best = F.array_max(votes)
    return F.when(best["n"] > 0, best["name"])


def scaled(confidence: Column, temperature: float) -> Column:
    """A confidence after temperature scaling of its log odds; 0 and 1 stay."""
    odds = F.log(confidence / (1 - confidence)) / temperature
    return F.when((confidence <= 0) | (confidence >= 1), confidence.cast("double")).otherwise(1 / (1 + F.exp(-odds)))


def faithfulness(summary: Column, sources: Column) -> Column:
    """The share of a summary's distinct words that its sources have; NULL for a summary without words."""
    words = lambda c: F.array_remove(F.array_distinct(F.split(F.lower(c), r"[^\p{L}\p{N}]+")), "")
    own = words(summary)
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, words(sources))) / F.size(own))
