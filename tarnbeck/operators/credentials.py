"""Names of credentials in recorded requests, found by reading the JSON's tokens.

A name counts as a key of an object at any depth, and as the first of an array of exactly two whose first is a string,
whatever the second is. Names inside longer strings, in values and in arrays of other lengths don't count. The tokens are
read in the row itself, whatever the nesting, and once more behind each candidate; nothing is exploded or joined.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of credential parameters, in any case.
NAMES = ("apikey", "api_key", "token", "access_token")
_TOKEN = r'"(?:[^"\\]|\\.)*"|[\[\]{}:,]|[^\s\[\]{}:,"]+'


def _text(token: Column) -> Column:
    """A string token's text, escapes read; null for other tokens."""
    read = F.get(F.from_json(F.concat(F.lit("["), token, F.lit("]")), "array<string>"), F.lit(0))
    return F.when(F.startswith(token, F.lit('"')), read)


def credential_names(request: Column) -> Column:
    """Sorted, repeats included; null or malformed JSON has none."""
    tokens = F.regexp_extract_all(request, F.lit(_TOKEN), F.lit(0))
    some = F.rlike(F.lower(request), F.lit("\\\\u|" + "|".join(NAMES)))  # most requests need no reading
    found = F.when(some & F.try_parse_json(request).isNotNull(), F.array_sort(_names(tokens)))
    return F.coalesce(found, F.array().cast("array<string>"))


def _names(tokens: Column) -> Column:
    token = lambda i: F.get(tokens, i)
    places = F.filter(F.transform(tokens, lambda t, i: F.when(F.startswith(t, F.lit('"')) & F.lower(_text(t)).isin(*NAMES), i)), lambda i: i.isNotNull())

    def pair(i: Column) -> Column:
        """Whether the array that opens before place i ends after one more value: no comma of its own from i + 2 on."""
        start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("commas"), F.lit(False).alias("ended"))
        step = lambda s, t: F.when(s["ended"], s).otherwise(F.struct(
            (s["depth"] + F.when(t.isin("[", "{"), 1).when(t.isin("]", "}"), -1).otherwise(0)).alias("depth"),
            (s["commas"] + F.when((t == ",") & (s["depth"] == 0), 1).otherwise(0)).alias("commas"),
            ((s["depth"] == 0) & t.isin("]", "}")).alias("ended")))
        rest = F.aggregate(F.slice(tokens, i + 3, F.size(tokens)), start, step)
        return (F.when(i > 0, token(i - 1)) == "[") & (token(i + 1) == ",") & (rest["commas"] == 0)

    found = F.filter(places, lambda i: (token(i + 1) == ":") | F.coalesce(pair(i), F.lit(False)))
    return F.transform(found, lambda i: _text(token(i)))
