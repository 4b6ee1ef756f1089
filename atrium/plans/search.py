"""Hierarchical search: "<object> in the <room> on floor <n>" narrows floors, rooms and objects in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.phrases import ROOM_STRUCTURE, is_structural, parse_floor, parse_object, parse_room
from ..functions.vector import dot, mean_vectors
from ..operators import cells


def parse(queries: DataFrame, text: str = "query") -> DataFrame:
    """Further columns floor_no (int), room_name and object_name; a part that isn't named is null."""
    c = F.col(text)
    return queries.withColumn("floor_no", parse_floor(c)).withColumn("room_name", parse_room(c)).withColumn("object_name", parse_object(c))


def floor_ranks(floors: DataFrame, level: str = "level", keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, floor_id and floor_no (from 1) by zero level: what a floor number in a phrase refers to.

    keys: the scene's, without which all floors are those of one building.
    """
    return floors.select(*keys, "floor_id", F.row_number().over(W.partitionBy(*keys).orderBy(level, "floor_id")).alias("floor_no"))


def query_floor(queries: DataFrame, floors: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, query_id, floor_id: the floor that a text names.

    A whole number is a rank by zero level from 1, out of range it finds
    nothing; any other text takes the floor whose ``prompt`` (the embedding of
    its name) is most similar, ties the lowest.  queries: keys, query_id, query,
    prompt; floors: keys, floor_id, floor_no, prompt.
    """
    names = list(keys)
    asked = queries.withColumn("asked", F.trim("query").try_cast("int"))
    by_number = asked.where("asked is not null").select(*names, "query_id", "asked").join(floors.select(*names, "floor_id", F.col("floor_no").alias("asked")), [*names, "asked"]).select(*names, "query_id", "floor_id")
    texts = asked.where("asked is null").select(*names, "query_id", F.col("prompt").alias("q_prompt"))
    # a scene has a few floors, and every text of a scene is held against them
    floors = floors.select(*names, "floor_id", "floor_no", "prompt")
    met = texts.join(floors, names) if names else texts.crossJoin(floors)
    best = met.groupBy(*names, "query_id").agg(F.min_by("floor_id", F.struct((-dot("prompt", "q_prompt")).alias("far"), "floor_no")).alias("floor_id"))
    return by_number.unionByName(best)


def _on_floor(queries: DataFrame, items: DataFrame, *columns: str) -> DataFrame:
    """Items of each query's floor, by equi-join; queries of no floor (null) meet all items, as a stated small set."""
    own = queries.where("floor_id is not null").join(items, "floor_id").select("query_id", "q_prompt", *columns)
    every = queries.where("floor_id is null").select("query_id", "q_prompt").join(items.select(*columns))
    return own.unionByName(every)


def query_room(queries: DataFrame, rooms: DataFrame, method: str = "view_embedding", k: int = 3, margin: float = 1e-3) -> DataFrame:
    """query_id, rank, room_id, sim: the rooms that match each query best, on its floor if it has one.

    queries: query_id, floor_id (null: all floors), prompt; rooms: room_id,
    floor_id, embedding.  method: "view_embedding" (a row a view; the k rooms of
    the nearest view), "children_embedding" (a row an object; the k rooms of
    largest mean similarity), or "label" (a row a room with its name's
    embedding; all rooms within ``margin`` of the best).
    """
    met = _on_floor(queries.withColumnRenamed("prompt", "q_prompt"), rooms, "room_id", "embedding")
    sims = met.select("query_id", "room_id", dot("embedding", "q_prompt").alias("sim"))
    best = sims.groupBy("query_id", "room_id").agg((F.avg("sim") if method == "children_embedding" else F.max("sim")).alias("sim"))
    order = W.partitionBy("query_id").orderBy(F.desc("sim"), "room_id")
    ranked = best.withColumn("rank", F.row_number().over(order))
    if method == "label":
        return ranked.withColumn("top", F.max("sim").over(W.partitionBy("query_id"))).where(F.col("top") - F.col("sim") < margin).drop("top")
    return ranked.where(F.col("rank") <= k)


def query_graph(queries: DataFrame, objects: DataFrame, rooms: DataFrame, k: int = 5, index: cells.Cells | None = None) -> DataFrame:
    """query_id, rank, object_id, room_id, room_name, sim: the k nearest objects of the whole graph, with their rooms.

    queries (query_id, prompt) are a stated small set; objects without an
    embedding are never found.  With an index of the objects (cells.build), only
    cells that may hold one of the k are scored, and ``scored`` tells how many objects were.
    """
    if index is not None:
        found = cells.top_k(index, queries.select("query_id", "prompt"), k, "query_id", "prompt")
        return found.join(objects.select("object_id", "room_id"), "object_id").join(rooms.select("room_id", "room_name"), "room_id", "left")
    met = objects.where("embedding is not null").join(queries.select("query_id", "prompt"))
    scored = met.select("query_id", "object_id", "room_id", dot("embedding", "prompt").alias("sim"))
    order = W.partitionBy("query_id").orderBy(F.desc("sim"), "object_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).join(rooms.select("room_id", "room_name"), "room_id", "left")


def hierarchical(queries: DataFrame, floors: DataFrame, rooms: DataFrame, objects: DataFrame, vocabulary: DataFrame, k: int, negatives: Column | None = None) -> DataFrame:
    """The k best objects of each query.

    queries: query_id, query; floors: floor_id, floor_no; rooms: room_id,
    floor_id, room_name; objects: object_id, room_id, embedding; vocabulary:
    name, embedding as prompt vector.  A query's floor and room narrow the
    objects if named; an unknown floor or room finds nothing.  Objects are
    ranked by similarity to the named prompt; those nearer to a ``negatives``
    prompt (a condition on vocabulary.name) come after all others.
    """
    parsed = parse(queries)
    placed = parsed.join(floors, "floor_no", "left").where("floor_no is null or floor_id is not null").withColumnRenamed("floor_id", "q_floor")
    rooms = rooms.select("room_id", "floor_id", F.col("room_name").alias("r_name"))
    # queries that name a room, or only a floor, meet rooms by equality; those that name neither meet all rooms
    named = placed.where("room_name is not null").join(rooms, F.col("room_name") == F.col("r_name")).where("q_floor is null or q_floor = floor_id")
    on_floor = placed.where("room_name is null and q_floor is not null").join(rooms, F.col("q_floor") == F.col("floor_id"))
    anywhere = placed.where("room_name is null and q_floor is null").join(rooms)
    found = named.unionByName(on_floor).unionByName(anywhere)
    words = vocabulary.select(F.col("name").alias("object_name"), F.col("prompt"))
    asked = found.join(words, "object_name").select("query_id", "room_id", "floor_id", "prompt")
    scored = asked.join(objects, "room_id").withColumn("sim", dot("embedding", "prompt"))
    wins = F.lit(1)
    if negatives is not None:
        # the negatives are a few prompts of the vocabulary, in one row; only objects of the queries' rooms are held against them
        against = vocabulary.where(negatives).agg(F.collect_list("prompt").alias("against"))
        scored = scored.join(against).withColumn("rival", F.array_max(F.transform("against", lambda p: dot("embedding", p))))
        wins = F.when(F.col("rival").isNull() | (F.col("sim") >= F.col("rival")), 1).otherwise(0)
    scored = scored.withColumn("wins", wins)
    order = W.partitionBy("query_id").orderBy(F.desc("wins"), F.desc("sim"), "object_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "floor_id", "room_id", "object_id", "sim", "wins")


def name_rooms(views: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """room_id and name: each view votes for its nearest vocabulary entry, ties go to the least class."""
    scored = views.crossJoin(vocabulary).withColumn("sim", dot("embedding", "prompt"))
    votes = scored.groupBy("room_id", "view_id").agg(F.min_by(F.struct("class", "name"), F.struct(-F.col("sim"), F.col("class"))).alias("vote"))
    counts = votes.groupBy("room_id", F.col("vote.class").alias("class"), F.col("vote.name").alias("name")).agg(F.count("*").alias("votes"))
    return counts.groupBy("room_id").agg(F.min_by("name", F.struct(-F.col("votes"), F.col("class"))).alias("name"))


def name_rooms_by_objects(objects: DataFrame, vocabulary: DataFrame | None = None, excluded: tuple[str, ...] = ROOM_STRUCTURE) -> DataFrame:
    """room_id and name from a room's objects: without a vocabulary the most frequent object name that isn't structure
    (ties the least name), else the vocabulary entry nearest to the mean of the objects' embeddings (ties the least class).

    A room of structure alone gets no name by label.
    """
    if vocabulary is None:
        counts = objects.where(~is_structural(F.col("name"), excluded)).groupBy("room_id", "name").agg(F.count("*").alias("n"))
        return counts.groupBy("room_id").agg(F.min_by("name", F.struct(-F.col("n"), F.col("name"))).alias("name"))
    means = mean_vectors(objects.where("embedding is not null"), ["room_id"], "embedding")
    scored = means.join(vocabulary.select("class", "name", "prompt")).withColumn("far", -dot("mean_vector", "prompt"))
    return scored.groupBy("room_id").agg(F.min_by("name", F.struct("far", "class")).alias("name"))


def long_queries(objects: DataFrame) -> DataFrame:
    """object_id and query: every form of phrase that asks for an object; objects of one query are its answers."""
    name, room, floor = F.col("object_name"), F.col("room_name"), F.col("floor_no").cast("string")
    forms = F.array(name, F.concat(name, F.lit(" in the "), room), F.concat(name, F.lit(" on floor "), floor), F.concat(name, F.lit(" in the "), room, F.lit(" on floor "), floor))
    return objects.select("object_id", F.explode(forms).alias("query"))


def valid_answers(objects: DataFrame, same_floor: bool = False) -> DataFrame:
    """object_id, answer_set, answers: the objects that answer the same question, as a set's id and size.

    An answer has the room category and the object category of the one that was
    asked for, on any floor, or on the same one.  answer_set is the least
    object_id of the set, so that sets aren't expanded into pairs.
    """
    by = ["room_category", "object_category", *(["floor_id"] if same_floor else [])]
    sets = objects.groupBy(*by).agg(F.min("object_id").alias("answer_set"), F.count("*").alias("answers"))
    return objects.join(sets, by).select("object_id", "answer_set", "answers")


def similar_categories(names: DataFrame, synonyms: DataFrame, name: str = "name") -> DataFrame:
    """names with ``similar``: each category that a table (category, similar) lists for the lowered name; null if none."""
    listed = synonyms.select(F.lower("category").alias("listed"), "similar").distinct()
    return names.join(listed, F.lower(name) == F.col("listed"), "left").drop("listed")
