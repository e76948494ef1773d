"""Defects of annotations, labels by path, and what is unlabelled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probity.storage import materialise

PART_ROWS = 1 << 20  # of one task, on average


def coco_defects(images: DataFrame, categories: DataFrame, annotations: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """annotation_id, image_id, defect and severity; an annotation may have several.

    ``images``: id and, with ``files`` (name), file_name, and width and height if they are declared;
    ``categories``: id; ``annotations``: annotation_id, image_id, category_id, w, h and x, y if there are any. A box
    may reach one pixel beyond declared sides. Ids may be text: one that is
    no integer is a defect, and nothing refers to it. What targets no declared image is dangling and
    judged no further but for repeated ids. Declared images whose file is absent are named by image_id.

    Rows are dealt to as many tasks as they need, and an annotation goes on as its id, image and the
    defects it has as bits, so that a task's memory does not grow with the input.
    """
    whole = lambda c: F.col(c).cast("string").try_cast("long")
    odd = lambda c: F.col(c).isNotNull() & whole(c).isNull()
    sides = [F.max(c).alias(f"i_{c}") for c in ("width", "height") if c in images.columns]
    tasks = max(int(images.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-max(annotations.count(), images.count()) // PART_ROWS))
    declared = images.withColumn("i_id", whole("id")).repartition(tasks, "i_id")
    declared = declared.groupBy("i_id").agg(*sides) if sides else declared.select("i_id").distinct()
    # written, so that its size is known before the join: a few categories would put all annotations in as few tasks
    classes = materialise(categories.select(whole("id").alias("c_id")).distinct(), "categories")
    known = annotations.withColumn("a_image", whole("image_id")).repartition(tasks, "a_image").join(declared.hint("merge"), F.col("a_image") == F.col("i_id"), "left").join(classes, whole("category_id") == F.col("c_id"), "left")
    outside = F.lit(False)
    for c in ("x", "y"):
        if c in annotations.columns:
            outside = outside | (F.col(c) < 0)
    if {"width", "height"} <= set(images.columns) and {"x", "y"} <= set(annotations.columns):
        beyond = (F.col("x") + F.col("w") > F.col("i_width") + 1) | (F.col("y") + F.col("h") > F.col("i_height") + 1)
        outside = outside | F.coalesce((F.col("i_width") > 0) & (F.col("i_height") > 0) & beyond, F.lit(False))
    box = F.coalesce((F.col("w") <= 0) | (F.col("h") <= 0) | outside, F.lit(True))
    there = F.col("i_id").isNotNull()
    rules = [
        (~there, "dangling-annotation", "HIGH"), (there & odd("category_id"), "non-integer-id", "HIGH"), (there & ~odd("category_id") & F.col("category_id").isNotNull() & F.col("c_id").isNull(), "undeclared-category", "HIGH"),
        (F.lit(False), "duplicate-annotation-id", "MEDIUM"), (there & box, "invalid-bbox", "MEDIUM"),
    ]
    bits = F.lit(0)
    for k, (cond, _, _) in enumerate(rules):
        bits = bits.bitwiseOR(F.when(cond, 1 << k).otherwise(0))
    judged = known.select("annotation_id", "image_id", bits.alias("bits")).repartition(tasks, "annotation_id")
    twice = F.col("annotation_id").isNotNull() & (F.count("*").over(Window.partitionBy("annotation_id")) > 1)
    judged = judged.withColumn("bits", F.col("bits").bitwiseOR(F.when(twice, 1 << 3).otherwise(0)))
    found = F.array_compact(F.array(*[F.when(F.col("bits").bitwiseAND(1 << k) > 0, F.struct(F.lit(name).alias("defect"), F.lit(severity).alias("severity"))) for k, (_, name, severity) in enumerate(rules)]))
    out = judged.select("annotation_id", F.col("image_id").cast("string").alias("image_id"), F.explode(found).alias("d")).select("annotation_id", "image_id", "d.*")
    nothing = F.lit(None).cast(annotations.schema["annotation_id"].dataType).alias("annotation_id")
    named = lambda rows, c, defect, severity: rows.select(nothing, c.cast("string").alias("image_id"), F.lit(defect).alias("defect"), F.lit(severity).alias("severity"))
    out = out.union(named(images.filter(odd("id")), F.col("id"), "non-integer-id", "HIGH")).union(named(categories.filter(odd("id")), F.lit(None), "non-integer-id", "HIGH"))
    if files is not None:
        base = F.element_at(F.split(F.translate("file_name", "\\", "/"), "/"), -1)
        there = files.select(F.col("name").alias("f_name")).repartition(tasks, "f_name").distinct()
        absent = images.filter(whole("id").isNotNull() & (F.col("file_name") != "")).withColumn("base", base).repartition(tasks, "base").join(there.hint("merge"), F.col("base") == F.col("f_name"), "left_anti")
        out = out.union(named(absent, F.col("id"), "missing-image", "MEDIUM"))
    return out


def orphan_labels(labels: DataFrame, images: DataFrame) -> DataFrame:
    """Label files whose name, without folder and extension, no image has. Columns: path."""
    stem = lambda c: F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.[^.]*$", "")
    return labels.join(images.select(stem(F.col("path")).alias("i_stem")).distinct(), stem(F.col("path")) == F.col("i_stem"), "left_anti")


def majority_label(annotations: DataFrame) -> DataFrame:
    """Commonest category of each image; ties go to the lesser."""
    counted = annotations.groupBy("image_id", "category_id").agg(F.count("*").alias("n"))
    top = counted.groupBy("image_id").agg(F.max(F.struct("n", (-F.col("category_id")).alias("neg"))).alias("top"))
    return top.select("image_id", (-F.col("top.neg")).alias("category_id"), F.col("top.n").alias("n"))


def folder_labels(paths: DataFrame) -> DataFrame:
    """Label of each sample by its parent folder; FLAT layout where fewer than two labels occur."""
    named = paths.select("sample_id", F.element_at(F.split("path", "/"), -2).alias("label"))
    layout = named.agg(F.when(F.count_distinct("label") < 2, "FLAT").otherwise("FOLDERS").alias("layout"))
    return named.withColumn("layout", layout.scalar())


def unlabelled(samples: DataFrame, labels: DataFrame) -> DataFrame:
    """Samples without any label."""
    return samples.join(labels.select(F.col("sample_id").alias("l_id")), F.col("sample_id") == F.col("l_id"), "left_anti")


def class_imbalance(samples: DataFrame) -> DataFrame:
    """One row: classes, largest, smallest, their ratio and severity."""
    out = samples.groupBy("label").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_classes"), F.max("n").alias("max_count"), F.min("n").alias("min_count"))
    ratio = F.col("max_count") / F.col("min_count")
    return out.withColumn("ratio", F.round(ratio, 6)).withColumn("severity", F.when(ratio >= 25, "HIGH").when(ratio > 8, "MEDIUM").otherwise("INFO"))


def contributor_resolution(samples: DataFrame, manifest: DataFrame, most: int = 64) -> DataFrame:
    """Contributor of each sample and the strategy by which all are resolved.

    A manifest (name, contributor) serves if it names half of the samples; else a folder that hints a
    contributor; else the top folder, if there are 2 to ``most``; else all are of one source.
    ``samples``: sample_id, path. The strategy is one row that meets all rows; no branch on the driver.
    """
    base = F.element_at(F.split("path", "/"), -1)
    hinted = F.nullif(F.regexp_extract("path", r"(?i)(?:^|/)((?:contributor|source|vendor|annotator|src)[_-]?\w*)/", 1), F.lit(""))
    top = F.when(F.instr("path", "/") > 0, F.element_at(F.split("path", "/"), 1))
    named = manifest.select(F.col("name").alias("m_name"), F.col("contributor").alias("by_manifest")).dropDuplicates(["m_name"])
    rows = samples.select("sample_id", base.alias("base"), hinted.alias("by_hint"), top.alias("by_top")).join(named, F.col("base") == F.col("m_name"), "left")
    half = F.count("*") / 2
    tops = F.count_distinct("by_top")
    chosen = rows.agg(F.when(F.count("by_manifest") >= half, "MANIFEST").when(F.count("by_hint") >= half, "HINTED_FOLDER").when((tops >= 2) & (tops <= most), "TOP_FOLDER").otherwise("SINGLE_SOURCE").alias("strategy"))
    met = rows.withColumn("strategy", chosen.scalar())
    pick = F.when(F.col("strategy") == "MANIFEST", F.col("by_manifest")).when(F.col("strategy") == "HINTED_FOLDER", F.col("by_hint")).when(F.col("strategy") == "TOP_FOLDER", F.col("by_top")).otherwise("SINGLE_SOURCE")
    return met.select("sample_id", F.coalesce(pick, F.lit("UNATTRIBUTED")).alias("contributor"), "strategy")


def yolo_defects(lines: DataFrame, n_classes: int) -> DataFrame:
    """Defect of each label line, if any. Columns: path, line_no, value.

    A line is split once and each of its numbers read once: they are bound as variables of higher-order functions,
    since as columns the optimizer would write them anew wherever they are used.
    """
    bound = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))

    def read(parts: Column) -> Column:
        number = lambda k: F.try_element_at(parts, F.lit(k)).try_cast("double")
        return F.struct(F.size(parts).alias("n"), F.try_element_at(parts, F.lit(1)).try_cast("int").alias("cls"), *[number(k).alias(f"x{k}") for k in (2, 3, 4, 5)])

    def judged(line: Column) -> Column:
        cls, box = line["cls"], [line[f"x{k}"] for k in (2, 3, 4, 5)]
        missing, outside = cls.isNull(), F.lit(False)
        for x in box:
            missing, outside = missing | x.isNull(), outside | (x < 0) | (x > 1)
        return (
            F.when(line["n"] < 5, "malformed").when(missing, "malformed").when(cls < 0, "negative-class").when(cls >= n_classes, "class-overflow")
            .when(outside, "coordinates-out-of-range").when((box[2] <= 0) | (box[3] <= 0), "degenerate-box")
        )

    fault = bound(bound(F.split(F.trim("value"), r"\s+"), read), judged)
    return lines.select("path", "line_no", fault.alias("defect")).filter("defect is not null")
