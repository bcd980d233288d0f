"""Language identification by stop words, with probabilities that add up to one."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Frequent words by language.
STOPS = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were her all she there would their",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son aux ou mais comme on nous sa cette ils leur",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser",
    "it": "di e il la che in a per un del non sono una con si da le è i dei al come più ma lo della alla gli anche nel ha",
    "nl": "de van het een en in is dat op te zijn met voor niet aan er die om dan ook als maar bij of uit door over ze naar wordt",
}
_SETS = {k: frozenset(v.split()) for k, v in STOPS.items()}
_WORD = re.compile(r"[^\W\d_]+")
SURE = 0.9


def identify(text: str | None) -> tuple[str, float]:
    found = _WORD.findall((text or "").lower())
    if not found:
        return "unknown", 0.0
    hits = {k: sum(w in s for w in found) for k, s in _SETS.items()}
    top = max(hits.values())
    weights = {k: math.exp(min(50, 2.0 * (h - top))) for k, h in hits.items()}
    best = max(weights, key=lambda k: (weights[k], k))
    return best, weights[best] / sum(weights.values())


def language(text: Column) -> Column:
    """STRUCT<lang, prob>."""

    @F.pandas_udf("lang string, prob double")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([identify(x) for x in texts], columns=["lang", "prob"])

    return run(text)


def bucket(lang: Column, prob: Column, sure: float = SURE) -> Column:
    """The language's folder; ``unsure`` below the needed probability."""
    return F.when(prob >= sure, lang).otherwise("unsure")
