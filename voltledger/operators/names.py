"""Which names of a table a text contains, without comparing every text with every name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD = 4
#: Names are broadcast up to so many, counted beforehand; beyond that both sides are sorted and merged.
FEW = 100_000


def contained(texts: DataFrame, names: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """Rows of texts (text, columns of on) beside the columns of names (name, columns of on) that the text contains, whatever the case.

    Equality joins only: at each place of a text the four characters there (all of a shorter name) tell which lengths
    names that begin so have, and the words of those lengths that first occur there then meet the names. So the work grows with the
    texts' characters and with what is found, even if all names begin alike. Each distinct text is looked at once. Beginnings of
    names are few and mostly broadcast, so that a text stays where it is while it is looked at (beyond FEW it travels once a character);
    the words travel to the names with a hash of their text (and its number among texts of that hash), and the matches go back to the text by it. An
    empty name is in every text; a null text or name is in none. The columns of names but for on shouldn't be those of texts."""
    held = texts.where("text is not null").groupBy(*on, F.xxhash64("text").alias("_hash")).agg(F.sort_array(F.collect_set("text")).alias("_texts"))
    once = held.select(*on, "_hash", F.posexplode("_texts").alias("_nth", "text"))
    at = lambda n: f"transform(filter(sequence(1, greatest(length(_lower), 1)), i -> i + {n - 1} <= length(_lower)), i -> named_struct('at', i, 'head', substr(_lower, i, {n})))"
    places = F.expr(f"concat(array(named_struct('at', 1, 'head', '')), {', '.join(at(n) for n in range(1, HEAD + 1))})")
    named = names.withColumn("_name", F.lower("name")).where("_name is not null")
    heads = named.groupBy(*on, F.substring("_name", 1, HEAD).alias("_head")).agg(F.collect_set(F.length("_name")).alias("_lengths"))
    how = lambda rows: "broadcast" if rows.limit(FEW + 1).count() <= FEW else "merge"
    text = [*on, "_hash", "_nth"]
    begun = once.select(*text, F.lower("text").alias("_lower")).select(*text, "_lower", F.explode(places).alias("_p")).select(*text, "_lower", F.col("_p.at").alias("_at"), F.col("_p.head").alias("_head")).join(heads.hint(how(heads)), [*on, "_head"])
    words = begun.select(*text, "_lower", "_at", F.explode(F.expr("transform(filter(_lengths, n -> _at + n - 1 <= length(_lower)), n -> substr(_lower, _at, n))")).alias("_name"))
    # a word that occurs again is looked up at its first place only
    first = words.where(F.expr("locate(_name, _lower) = _at")).select(*text, "_name")
    met = first.join(named.hint(how(named)), [*on, "_name"]).drop("_name")
    return met.hint("merge").join(once.hint("merge"), text).drop("_hash", "_nth")
