"""Names of word senses: decoding, listing and choosing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.sources.storage import store


def decode_names(nodes: DataFrame, always: bool = False) -> DataFrame:
    """``(id, name, decoded, path, path_ids)`` of the nodes named ``term>part>part``.

    A numeric part is a node id and becomes that node's name (``<id:N>`` if
    there is none); other parts stay.  Without any numeric part the name stays
    as it is, unless ``always``.  Nodes are joined by shuffle here and wherever
    else they are looked up: many names are few bytes as a stored file.
    """
    senses = nodes.filter(F.col("name").contains(">")).select("id", "name", F.split("name", ">").alias("tokens"))
    parts = senses.select("id", "name", F.posexplode("tokens").alias("pos", "token")).filter("pos > 0 and token <> ''").withColumn("part_id", F.expr("try_cast(token as bigint)"))
    labels = nodes.select(F.col("id").alias("part_id"), F.col("name").alias("label"))
    labelled = parts.join(labels.hint("merge"), "part_id", "left").withColumn("text", F.when(F.col("part_id").isNull(), F.col("token")).otherwise(F.coalesce("label", F.concat(F.lit("<id:"), "token", F.lit(">")))))
    grouped = labelled.groupBy("id", "name").agg(F.array_sort(F.collect_list(F.struct("pos", "text", "part_id"))).alias("parts"))
    path = F.transform("parts", lambda p: p.text)
    ids = F.filter(F.transform("parts", lambda p: p.part_id), lambda x: x.isNotNull())
    decorated = F.concat(F.substring_index("name", ">", 1), F.lit(" ("), F.array_join(path, ", "), F.lit(")"))
    decoded = decorated if always else F.when(F.size(ids) > 0, decorated).otherwise(F.col("name"))
    return grouped.select("id", "name", decoded.alias("decoded"), path.alias("path"), ids.alias("path_ids"))


def lookup_terms(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per asked ``term`` its node as ``(term, id, name, decoded, type, weight, error)``; an unknown term has an error only."""
    shown = decode_names(nodes).select("id", "decoded")
    found = nodes.join(asked.select(F.col("term").alias("name")).distinct(), "name", "left_semi").join(shown, "id", "left")
    found = found.select(F.col("name").alias("term"), "id", "name", F.coalesce("decoded", "name").alias("decoded"), "type", F.col("w").alias("weight"))
    error = F.when(F.col("id").isNull(), F.concat(F.lit("terme inconnu : "), "term"))
    return asked.select("term").distinct().join(found, "term", "left").withColumn("error", error)


def nodes_by_id(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes whose id is asked; an unknown id gives no row."""
    return nodes.join(asked.select("id").distinct(), "id", "left_semi")


def list_senses(nodes: DataFrame, graph: DataFrame, limit: int | None = None) -> DataFrame:
    """``(term, sense_id, sense, decoded, path, weight, turn)``: all senses of every term, strongest first, or its ``limit`` strongest."""
    term = F.substring_index("name", ">", 1)
    links = graph.filter("rel = 'r_raff_sem'").groupBy(F.col("src").alias("term"), F.col("tgt").alias("name")).agg(F.max("w").alias("link"))
    found = decode_names(nodes, always=True).withColumn("term", term).join(nodes.select("id", F.col("w").alias("own")).hint("merge"), "id").join(links.hint("merge"), ["term", "name"], "left")
    weight = F.coalesce("link", "own")
    turn = F.row_number().over(Window.partitionBy("term").orderBy(weight.desc(), "id"))
    listed = found.select("term", F.col("id").alias("sense_id"), F.col("name").alias("sense"), "decoded", "path", weight.alias("weight"), turn.alias("turn"))
    return listed if limit is None else listed.filter(F.col("turn") <= limit)


#: Lengths of the pieces of a text by which it is found: a needle goes by its longest ones, so by at least half of itself up to twice the last length.
LENGTHS = [1, 2, 4, 8, 16, 32, 64]


def _pieces(text: Column, n: Column | int) -> Column:
    """All pieces of ``n`` characters of a text; none if it is shorter."""
    n = F.lit(n) if isinstance(n, int) else n
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substr(text, i, n))


def _grams(text: Column) -> Column:
    """All distinct pieces of a text that needles may be sent to."""
    return F.array_distinct(F.concat(*[_pieces(text, n) for n in LENGTHS]))


def _key_grams(text: Column) -> Column:
    """The pieces of the greatest length that a text holds: whatever holds the text holds each of them."""
    return F.array_distinct(_pieces(text, F.greatest(*[F.when(F.length(text) >= n, n).otherwise(LENGTHS[0]) for n in LENGTHS])))


def contained_pairs(needles: DataFrame, hays: DataFrame) -> DataFrame:
    """Distinct ``(group, needle, hay)``: the texts ``needle`` that a text ``hay`` of the same ``group`` contains.

    A needle is sent to the rarest of its pieces only, a hay to all of its own,
    so pairs without a common piece never meet; what meets is compared.  Empty
    needles are in every hay and must not be asked.  Joins are by shuffle: the
    tables are small as files, not as what a driver would have to hold.
    """
    # Dealt in a fixed number of parts: adaptive execution would put few short texts into one task, which then cuts all their pieces.
    parts = int(needles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    needles, hays = needles.select("group", "needle").repartition(parts, "group", "needle").distinct(), hays.select("group", "hay").repartition(parts, "group", "hay").distinct()
    held = hays.select("group", "hay", F.explode(_grams(F.col("hay"))).alias("gram"))
    asked = needles.select("group", "needle", F.explode(_key_grams(F.col("needle"))).alias("gram"))
    # A needle with a piece that no hay of its group holds is in none of them.
    often = held.groupBy("group", "gram").agg(F.count("*").alias("n"))
    counted = asked.join(often.hint("merge"), ["group", "gram"], "left").groupBy("group", "needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("x"))
    rarest = counted.filter("x.n > 0").select("group", "needle", "x.gram")
    return rarest.join(held.hint("merge"), ["group", "gram"]).filter(F.contains("hay", F.col("needle"))).select("group", "needle", "hay")


def resolve_senses(terms: DataFrame, senses: DataFrame) -> DataFrame:
    """``(soft, name)`` of soft references ``term>hint>hint``: the sense that most hints match, else null.

    A term without hints, or with numeric ones only, is its own name.  A hint
    matches if it contains, or is contained in, a part of the path, or is
    contained in the decoded name; the earliest listed of the best senses wins.
    Hints find their senses by the pieces of their texts, so a term may have
    any number of senses.
    """
    hints = F.filter(F.transform(F.split("soft", ">"), lambda x: F.lower(F.trim(x))), lambda x, i: (i > 0) & (x != ""))
    asked = terms.select("soft", F.trim(F.substring_index("soft", ">", 1)).alias("term"), hints.alias("hints")).distinct()
    numbers = F.forall("hints", lambda h: h.rlike("^[0-9]+$"))
    direct = asked.filter(numbers).select("soft", F.when(F.size("hints") == 0, F.col("term")).otherwise(F.col("soft")).alias("name"))
    open_ = asked.filter(~numbers)
    hinted = open_.select("soft", F.col("term").alias("group"), F.explode("hints").alias("hint"))
    known = senses.select(F.col("term").alias("group"), "sense", "turn", "sense_id", F.lower("decoded").alias("shown"), F.explode(F.transform("path", lambda p: F.lower(p))).alias("part"))
    each = hinted.select("group", F.col("hint")).distinct()
    # The decoded name holds every part of the path: a hint inside a part is inside the name too.
    inside = contained_pairs(each.withColumnRenamed("hint", "needle"), known.select("group", F.col("shown").alias("hay"))).select("group", F.col("needle").alias("hint"), F.col("hay").alias("shown"))
    around = contained_pairs(known.filter("part <> ''").select("group", F.col("part").alias("needle")), each.withColumnRenamed("hint", "hay")).select("group", F.col("hay").alias("hint"), F.col("needle").alias("part"))
    columns = ["group", "hint", "sense", "turn", "sense_id"]
    met = inside.join(known.hint("merge"), ["group", "shown"]).select(columns).union(around.join(known.hint("merge"), ["group", "part"]).select(columns)).distinct()
    return direct.unionByName(open_.select("soft").join(_best_met(hinted, store(met, "met")).hint("merge"), "soft", "left"))


def _best_met(hinted: DataFrame, met: DataFrame) -> DataFrame:
    """``(soft, name)``: the sense that most hints of (soft, group, hint) match; ``met`` has the senses of every hint.

    Senses of a soft reference's commonest hint alone score alike, so only the
    first of them counts; all others match a rarer hint too and are listed by
    that.  So a hint that many senses match costs no row per reference.
    """
    lists = met.groupBy("group", "hint").agg(F.count("*").alias("n"), F.min(F.struct("turn", "sense_id", "sense")).alias("first"))
    each = hinted.groupBy("soft", "group", "hint").agg(F.count("*").alias("times")).join(lists.hint("merge"), ["group", "hint"])
    ranked = each.groupBy("soft", "group").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), "hint", "times", "first"))).alias("hints")).withColumn("most", F.col("hints")[0])
    rarer = ranked.select("soft", "group", "most", F.explode(F.slice("hints", 2, F.greatest(F.size("hints"), F.lit(1)))).alias("x")).select("soft", "group", "most", "x.hint", "x.times")
    found = rarer.join(met.hint("merge"), ["group", "hint"]).groupBy("soft", "group", "most", "turn", "sense_id", "sense").agg(F.sum("times").alias("score"))
    also = met.select("group", F.col("hint").alias("common"), "turn", F.lit(1).alias("also"))
    found = found.withColumn("common", F.col("most.hint")).join(also.hint("merge"), ["group", "common", "turn"], "left")
    scored = found.select("soft", "turn", "sense_id", "sense", (F.col("score") + F.when(F.col("also").isNotNull(), F.col("most.times")).otherwise(0)).alias("score"))
    scored = scored.unionByName(ranked.select("soft", "most.first.turn", "most.first.sense_id", "most.first.sense", F.col("most.times").alias("score")))
    return scored.groupBy("soft").agg(F.min_by("sense", F.struct(-F.col("score"), "turn", "sense_id")).alias("name"))


def contaminated_senses(senses: DataFrame, graph: DataFrame) -> DataFrame:
    """Triplets of a generic term that a later sense has and the first sense has not: ``(term, rel, tgt, sense)``."""
    of_sense = graph.select(F.col("src").alias("sense"), "rel", "tgt").distinct()
    held = senses.select("term", "sense", "turn").join(of_sense, "sense")
    generic = graph.select(F.col("src").alias("term"), "rel", "tgt").distinct()
    first = held.filter("turn = 1").select("term", "rel", "tgt")
    return generic.join(held.filter("turn > 1"), ["term", "rel", "tgt"]).join(first, ["term", "rel", "tgt"], "left_anti").select("term", "rel", "tgt", "sense")


def shared_by_senses(senses: DataFrame, graph: DataFrame) -> DataFrame:
    """``(term, rel, tgt, n_senses)`` of triplets that two or more senses of a term have."""
    of_sense = graph.select(F.col("src").alias("sense"), "rel", "tgt").distinct()
    return senses.select("term", "sense").join(of_sense, "sense").groupBy("term", "rel", "tgt").agg(F.count("*").alias("n_senses")).filter("n_senses > 1")
