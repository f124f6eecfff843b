"""Tags on frames and labels: tagging, differences, propagation, tags from nested answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

NO_CLASSIFICATION = "no classification"


def create_tags(existing: DataFrame, names: DataFrame, project: str = "project") -> DataFrame:
    """Get-or-create: (project, tag, tag_id) for every requested (project, tag); ids of new tags derive from their key."""
    wanted = names.select(project, "tag").distinct()
    fresh = F.md5(F.concat_ws(":", F.col(project), F.col("tag")))
    return wanted.join(existing, [project, "tag"], "left").withColumn("tag_id", F.coalesce("tag_id", fresh))


def write_tags(bridge: DataFrame, items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bridge rows after attaching tags; attaching twice changes nothing."""
    return bridge.select(*keys, "tag").unionByName(items.select(*keys, "tag")).dropDuplicates([*keys, "tag"])


def tag_diff(existing: DataFrame, desired: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows to add and to remove so that ``existing`` becomes ``desired`` for the items listed in it."""
    cols = [*keys, "tag"]
    e, w = existing.select(*cols).distinct(), desired.select(*cols).distinct()
    touched = e.join(w.select(*keys), list(keys), "left_semi")
    add = w.join(e, cols, "left_anti").withColumn("action", F.lit("add"))
    drop = touched.join(w, cols, "left_anti").withColumn("action", F.lit("remove"))
    return add.unionByName(drop)


def tag_difference(existing: DataFrame, desired: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Existing tag rows no longer wanted."""
    cols = [*keys, "tag"]
    return existing.select(*cols).distinct().join(desired.select(*cols), cols, "left_anti")


def tagged_items(frame_tags: DataFrame, label_tags: DataFrame, frame: Sequence[str], label: str) -> DataFrame:
    """Tag sets per frame and per label (frame rows have a NULL label); label tags also reach their frame."""
    keys = list(frame)
    own = frame_tags.select(*keys, F.lit(None).cast(label_tags.schema[label].dataType).alias(label), "tag")
    raised = label_tags.select(*keys, F.lit(None).cast(label_tags.schema[label].dataType).alias(label), "tag")
    rows = own.unionByName(raised).unionByName(label_tags.select(*keys, label, "tag"))
    # a tag set is bounded by the tags of the project; partial sets are combined before the shuffle
    return rows.groupBy(*keys, label).agg(F.sort_array(F.collect_set("tag")).alias("tags"))


def eligible_questions(ontology: DataFrame) -> DataFrame:
    """Feature hashes of radio and checklist questions."""
    return ontology.where(F.col("type").isin("radio", "checklist")).select("feature_hash")


def nested_answer_tags(labels: DataFrame, answers: DataFrame, ontology: DataFrame, key: str) -> DataFrame:
    """"question: answer" per label for every radio / checklist answer; labels without one get "no classification".

    ``answers`` holds (key, feature_hash, question, answer ARRAY<STRING>).
    """
    listed = answers.join(eligible_questions(ontology), "feature_hash", "left_semi").select(
        key, "question", F.explode("answer").alias("answer")
    )
    named = listed.select(key, F.concat_ws(": ", "question", "answer").alias("tag"))
    return labels.select(key).join(named, key, "left").withColumn("tag", F.coalesce("tag", F.lit(NO_CLASSIFICATION)))


def radio_answer(answers: Column) -> Column:
    """First answer's name from answer JSON: an array of {name}, or a plain string returned as is, else null."""
    first = F.get_json_object(answers, "$[0].name")
    plain = F.when(answers.startswith('"'), F.from_json(F.concat(F.lit('{"v":'), answers, F.lit("}")), "v string")["v"])
    return F.coalesce(first, plain)
