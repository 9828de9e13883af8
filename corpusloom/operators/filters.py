"""Language and domain filters."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind
from .basic import broadcast_if_small

# Frequent function words by ISO 639-1 code, for the built-in detector.
FUNCTION_WORDS: dict[str, str] = {
    "en": "the of and to in is that for it was on are as with his they at be this from have or by one had not but what all were",
    "fr": "le la les de des du et en un une est que qui dans pour pas sur au avec ne se ce il sont par plus nous vous mais",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie",
    "es": "el la los las de que y en un una por con no se su para es al lo como más del pero sus le ya o este sí porque",
    "hu": "a az és hogy nem is egy ez van meg de csak már volt ki el még mint vagy ha azt mert aki ezt majd lesz itt ott",
}
# Public suffixes of more than one label in common use.
LONG_SUFFIXES = "co.uk org.uk ac.uk gov.uk com.au net.au org.au co.nz co.jp ne.jp or.jp co.kr com.br com.cn com.hk com.mx com.sg com.tr co.in co.za co.il com.ar com.tw".split()
UNDECIDED = "un"

Detector = Callable[[Column], Column]
DETECTORS: dict[str, Detector] = {}


def detector(name: str) -> Callable[[Detector], Detector]:
    """Registers a detector: Column of text -> Column of ISO code, or "un" or null where it cannot tell."""

    def put(f: Detector) -> Detector:
        DETECTORS[name] = f
        return f

    return put


@detector("function_words")
def by_function_words(text: Column) -> Column:
    """The language whose function words the text has most of; undecided without any or on a tie."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))
    number = lambda own, listed: F.size(F.filter(own, lambda x: x.isin(listed.split())))
    votes = lambda own: F.sort_array(F.array(*[F.struct(number(own, listed).alias("n"), F.lit(code).alias("code")) for code, listed in sorted(FUNCTION_WORDS.items())]), asc=False)
    best = lambda v: F.when((v[0]["n"] > 0) & (v[0]["n"] > v[1]["n"]), v[0]["code"]).otherwise(UNDECIDED)
    return bind(bind(words, votes), best)


@detector("trigrams")
def by_trigrams(text: Column) -> Column:
    """Like function_words, by the function words' letter trigrams with word bounds; settles texts without such words."""
    flat = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " ")), F.lit(" "))
    grams = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1))), lambda i: F.substr(t, i, F.lit(3)))
    share = lambda own, listed: F.size(F.filter(own, lambda g: g.isin(listed))) / F.lit(math.sqrt(len(listed)))
    votes = lambda own: F.sort_array(F.array(*[F.struct(share(own, listed).alias("n"), F.lit(code).alias("code")) for code, listed in sorted(trigram_profiles().items())]), asc=False)
    best = lambda v: F.when((v[0]["n"] > 0) & (v[0]["n"] > v[1]["n"]), v[0]["code"]).otherwise(UNDECIDED)
    return bind(bind(bind(flat, grams), votes), best)


def trigram_profiles() -> dict[str, list[str]]:
    """The letter trigrams, with word bounds, of each language's function words."""
    return {code: sorted({f" {w} "[i : i + 3] for w in own.split() for i in range(len(w))}) for code, own in FUNCTION_WORDS.items()}


def detect_language(fields: Sequence[Column], libraries: Sequence[str] = ("function_words",)) -> Column:
    """[L3 Q21] the first definite answer of the detectors on the fields joined by line feeds; null if none has one."""
    text = F.concat_ws("\n", *[F.coalesce(f, F.lit("")) for f in fields])
    return F.coalesce(*[F.nullif(DETECTORS[name](text), F.lit(UNDECIDED)) for name in libraries])


def language_filter(df: DataFrame, fields: Sequence[str], languages: Iterable[str], libraries: Sequence[str] = ("function_words",)) -> DataFrame:
    """[L3] rows whose detected language is one of those; rows in no definite language are dropped."""
    return df.where(detect_language([df[f] for f in fields if f in df.columns], libraries).isin(list(languages)))


def domain_parts(url: Column, suffixes: Sequence[str] = tuple(LONG_SUFFIXES)) -> Column:
    """subdomain, domain and suffix of a URL's lower-cased host; null where it has no host.  The longest suffix wins."""
    host = F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    last_two = F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), 2), ".")
    width = F.when((n > 2) & last_two.isin(list(suffixes)), 2).when(n > 1, 1).otherwise(0)
    part = lambda start, length: F.array_join(F.slice(labels, F.greatest(start, F.lit(1)), F.greatest(length, F.lit(0))), ".")
    made = F.struct(part(F.lit(1), n - width - 1).alias("subdomain"), F.get(labels, n - width - 1).alias("domain"), part(n - width + 1, width).alias("suffix"))
    return F.when(host != "", made)


def domain_filter(df: DataFrame, domains: DataFrame | Sequence[str], field: str = "url", expression: str = "suffix", retain: bool = True) -> DataFrame:
    """[L4] rows whose domain expression (SQL over subdomain, domain, suffix) is, or with retain False isn't, in the set.

    Rows without a usable URL are dropped either way.
    """
    made = df.withColumn("_parts", domain_parts(df[field])).where("_parts is not null")
    made = made.withColumns({f"_{c}": F.col(f"_parts.{c}") for c in ("subdomain", "domain", "suffix")})
    value = F.expr(re.sub(r"\b(subdomain|domain|suffix)\b", r"_\1", expression))
    made = made.withColumn("_value", value).where("_value is not null")
    if isinstance(domains, DataFrame):
        items = broadcast_if_small(domains.select(F.col(domains.columns[0]).alias("_value")).distinct())
        made = made.join(items, "_value", "left_semi" if retain else "left_anti")
    else:
        listed = F.col("_value").isin(list(domains)) if len(domains) else F.lit(False)
        made = made.where(listed if retain else ~listed)
    return made.select(*df.columns)
