"""Vendor of a document from what was read off it: by registration number, then by name, then by the client's own history.

Each pass works on what the one before left over. Names are compared as sets of words weighted by how rare they are among vendors. An
inverted index holds, for each vendor, its rarest words only: the fewest such that what is left weighs less than the least similarity
asks for. Two names as similar as that share a word of these shortest prefixes, so the join on them finds every pair, and frequent words
like "trading" are never join keys unless a name has nothing else.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import stage

#: Least weight of shared words, in percent of the weight of all words of both names.
LEAST = 60
# Short forms in names of firms.
SHORT_FORMS = {"co": "company", "trdg": "trading", "pvt": "private", "ltd": "limited", "corp": "corporation", "bros": "brothers", "ent": "enterprises", "ind": "industries", "mfg": "manufacturing", "intl": "international"}


def words(name: Column) -> Column:
    """Distinct words of a name: letters a-z and digits, lower case, short forms written out."""
    full = F.create_map(*[F.lit(x) for pair in SHORT_FORMS.items() for x in pair])
    return F.array_distinct(F.transform(F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda w: w != ""), lambda w: F.coalesce(full[w], w)))


def _weight(n: Column, holders: Column) -> Column:
    """Bits of how many times rarer a word is than one that every vendor has; a word that none has counts as one vendor's."""
    return F.length(F.bin(F.floor(n / F.greatest(holders, F.lit(1))))).cast("int")


def weighted(names: DataFrame, keys: list[str], name: str, index: DataFrame) -> DataFrame:
    """keys, total, bag (word -> weight), prefix: the words a similar name must share one of."""
    spread = names.select(*keys, F.explode(words(F.col(name))).alias("word")).join(index.select("word", "holders"), "word", "left")
    spread = spread.join(index.groupBy().agg(F.max("n").alias("n")), how="cross")  # one row: the number of vendors
    bag = spread.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct((-_weight(F.col("n"), F.coalesce("holders", F.lit(0)))).alias("w"), "word"))).alias("bag"))
    total = F.aggregate("bag", F.lit(0), lambda t, x: t - x["w"])
    left = lambda i: F.aggregate(F.slice("bag", i + 1, F.size("bag")), F.lit(0), lambda t, x: t - x["w"])
    return bag.withColumn("total", total).withColumn("prefix", F.transform(F.filter("bag", lambda x, i: left(i) * 100 >= F.col("total") * LEAST), lambda x: x["word"]))


def by_name(names: DataFrame, vendors: DataFrame, index: DataFrame) -> DataFrame:
    """client_id, name, party_id, score: the most similar vendor of the client, ties to the smaller id; score in thousandths."""
    q = weighted(names, ["client_id", "name"], "name", index).select("client_id", "name", F.col("bag").alias("q_bag"), F.col("total").alias("q_total"), F.explode("prefix").alias("word"))
    v = weighted(vendors.select("party_id", "party_name").distinct(), ["party_id"], "party_name", index).join(vendors.select("client_id", "party_id"), "party_id").select(
        "client_id", "party_id", F.col("bag").alias("v_bag"), F.col("total").alias("v_total"), F.explode("prefix").alias("word"))
    pairs = q.join(v, ["client_id", "word"]).drop("word").dropDuplicates(["client_id", "name", "party_id"])
    shared = F.aggregate(F.array_intersect("q_bag", "v_bag"), F.lit(0), lambda t, x: t - x["w"])
    union = F.col("q_total") + F.col("v_total") - F.col("shared")
    fit = pairs.withColumn("shared", shared).filter(F.col("shared") * 100 >= union * LEAST)
    best = F.min(F.struct((-F.floor(F.col("shared") * 1000 / union)).alias("below"), "party_id")).alias("best")
    return fit.groupBy("client_id", "name").agg(best).select("client_id", "name", "best.party_id", (-F.col("best.below")).cast("int").alias("score"))


def resolve_vendor(documents: DataFrame, vendors: DataFrame) -> DataFrame:
    """document_id, client_id, party_id, found_by, score of every document (document_id, client_id, name, gstin).

    vendors has client_id, party_id, party_name, gstin: those that a client deals with. found_by is number, name, history or unmatched; history is the
    vendor that the same name meant most often on the client's documents found by number.
    """
    docs, vendors = stage(documents), stage(vendors)
    known = vendors.select("party_id", "party_name").distinct()
    index = known.select("party_id", F.explode(words(F.col("party_name"))).alias("word")).groupBy("word").agg(F.count("*").alias("holders"))
    index = stage(index.join(known.agg(F.countDistinct("party_id").alias("n")), how="cross"))  # one row: the number of vendors
    numbers = vendors.filter("gstin IS NOT NULL").groupBy("client_id", "gstin").agg(F.min("party_id").alias("party_id"))
    first = stage(docs.join(numbers, ["client_id", "gstin"], "left"))
    found = first.filter("party_id IS NOT NULL").select("document_id", "client_id", "name", "party_id")
    rest = first.filter("party_id IS NULL").drop("party_id")
    names = by_name(rest.filter("name IS NOT NULL").select("client_id", "name").distinct(), vendors, index)
    seen = found.filter("name IS NOT NULL").groupBy("client_id", "name", "party_id").agg(F.count("*").alias("n"))
    habit = seen.groupBy("client_id", "name").agg(F.min(F.struct((-F.col("n")).alias("below"), "party_id")).alias("h")).select("client_id", "name", F.col("h.party_id").alias("h_party"))
    later = rest.join(names, ["client_id", "name"], "left").join(habit, ["client_id", "name"], "left")
    how = F.when(F.col("party_id").isNotNull(), "name").when(F.col("h_party").isNotNull(), "history").otherwise("unmatched")
    return found.select("document_id", "client_id", "party_id", F.lit("number").alias("found_by"), F.lit(None).cast("int").alias("score")).unionByName(
        later.select("document_id", "client_id", F.coalesce("party_id", "h_party").alias("party_id"), how.alias("found_by"), "score"))
