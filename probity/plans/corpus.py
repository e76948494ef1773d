"""Queries over samples, annotations, vectors, shift and model tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from probity.operators import annotations as a
from probity.operators import duplicates as dup
from probity.operators import findings as fin
from probity.operators import models as mod
from probity.operators import risk as r
from probity.operators import shift as sh
from probity.operators import vectors as vec
from probity.plans.bindings import sql, view
from probity.sources import manifest as man

QUERIES, ORACLE = {}, {}


def query(name: str, oracle: str | None = None):
    def add(function):
        QUERIES[name] = function
        if oracle:
            ORACLE[name] = sql(oracle)
        return function

    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("exact_duplicates", "SELECT sha256, count(*) AS sample_count, min(sample_id) AS first_id FROM samples GROUP BY sha256 HAVING count(*) > 1")
def _(s, d):
    return dup.exact_groups(view(s, d, "samples"))


@query("redundant_samples", "SELECT sample_id, contributor, first_id FROM (SELECT sample_id, contributor, min(sample_id) OVER (PARTITION BY sha256) AS first_id FROM samples) WHERE sample_id > first_id")
def _(s, d):
    return dup.redundant(view(s, d, "samples")).select("sample_id", "contributor", "first_id")


@query("fingerprint_statistics", "SELECT count(*) AS n, count(DISTINCT sha256) AS distinct_content, count(DISTINCT contributor) AS contributors FROM samples")
def _(s, d):
    return dup.fingerprint_statistics(view(s, d, "samples"))


def defects(s, d):
    """Exact copies, and labels of low quality and of toxic text, as defects of samples."""
    copies = dup.redundant(view(s, d, "samples")).select("sample_id", F.lit("exact").alias("kind"))
    labels = table(s, d, "labels")
    return copies.union(labels.filter("quality = 0").select("doc_id", F.lit("label"))).union(labels.filter("toxic = 1").select("doc_id", F.lit("trigger")))


DEFECTS = "SELECT sample_id, 'exact' AS kind FROM (SELECT sample_id, row_number() OVER (PARTITION BY sha256 ORDER BY sample_id) AS p FROM samples) WHERE p > 1 UNION ALL SELECT doc_id, 'label' FROM labels WHERE quality = 0 UNION ALL SELECT doc_id, 'trigger' FROM labels WHERE toxic = 1"


@query("contributor_risk", f"""WITH def AS ({DEFECTS}), x AS (SELECT contributor, count(DISTINCT s.sample_id) AS n, count(*) FILTER (kind = 'trigger') AS trig, count(*) FILTER (kind = 'label') AS lab, count(*) FILTER (kind = 'exact') AS exa FROM samples s LEFT JOIN def USING (sample_id) GROUP BY contributor)
 SELECT contributor, n, trig AS trigger_defects, lab AS label_defects, exa AS exact_duplicates, trig + lab + exa AS total_defects, round(least(100.0::DOUBLE, greatest(100 * (1 - exp(-(5.0::DOUBLE * trig + 3.0::DOUBLE * lab + exa) / n / 0.35::DOUBLE)) * (0.7::DOUBLE + 0.3::DOUBLE * least(1.0::DOUBLE, n / 50.0::DOUBLE)), CASE WHEN trig > 0 THEN 70 + least(25.0::DOUBLE, 25.0::DOUBLE * trig / n) ELSE 0 END)), 4) AS risk_score FROM x""")
def _(s, d):
    out = r.contributor_profile(view(s, d, "samples"), defects(s, d))
    return out.select("contributor", "n", F.col("trigger").alias("trigger_defects"), F.col("label").alias("label_defects"), F.col("exact").alias("exact_duplicates"), "total_defects", "risk_score").orderBy(F.desc("risk_score"), "contributor")


SHINGLES = "SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')))) AS s FROM (SELECT doc_id, string_split(lower(text), ' ') AS w FROM documents) WHERE len(w) >= 3"
SIMHASH = f"SELECT doc_id, bit_or(CASE WHEN v > 0 THEN (1::UBIGINT << b::UBIGINT) ELSE 0::UBIGINT END) AS u FROM (SELECT doc_id, b, sum(CASE WHEN (h >> b::UBIGINT) & 1::UBIGINT = 1 THEN 1 ELSE -1 END) AS v FROM (SELECT doc_id, ('0x' || substr(md5(s), 1, 16))::UBIGINT AS h FROM ({SHINGLES})), (SELECT unnest(range(64)) AS b) GROUP BY doc_id, b) GROUP BY doc_id"


@query("simhash_text", f"SELECT doc_id, CASE WHEN u >= 9223372036854775808::UBIGINT THEN (u - 9223372036854775808::UBIGINT)::BIGINT + (-9223372036854775808) ELSE u::BIGINT END AS fingerprint FROM ({SIMHASH})")
def _(s, d):
    return dup.simhash64(table(s, d, "documents"), "doc_id", "text")


def prints(s, d):
    content = view(s, d, "samples").select("sample_id", "sha256")
    return dup.simhash64(table(s, d, "documents"), "doc_id", "text").join(content.hint("merge"), F.col("doc_id") == F.col("sample_id")).select(F.col("doc_id").alias("id"), "fingerprint", "sha256")


PRINTS = f"p AS (SELECT doc_id, u, sha256 FROM ({SIMHASH}) JOIN samples ON sample_id = doc_id), f AS (SELECT u, min(doc_id) AS id, min(sha256) <> max(sha256) AS varied FROM p GROUP BY u), e AS (SELECT x.id AS a, y.id AS b, bit_count(xor(x.u, y.u)) AS distance FROM f x JOIN f y ON x.id < y.id WHERE bit_count(xor(x.u, y.u)) <= 5)"
#: clusters of all rows, the copies of a fingerprint among them
CLUSTERS = f"""WITH RECURSIVE {PRINTS}, g AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach AS (SELECT a AS node, a AS seen FROM g UNION SELECT reach.node, g.b FROM reach JOIN g ON g.a = reach.seen), least_of AS (SELECT node, min(seen) AS cluster FROM reach GROUP BY node),
 k AS (SELECT f.u, coalesce(c.cluster, f.id) AS cluster FROM f LEFT JOIN least_of c ON c.node = f.id WHERE varied OR c.node IS NOT NULL), near AS (SELECT doc_id AS sample_id, cluster, doc_id <> cluster AS redundant FROM p JOIN k USING (u))"""


@query("near_duplicate_pairs", f"""WITH {PRINTS}, s AS (SELECT u, min(sha256) AS lo, max(sha256) AS hi FROM p GROUP BY u), l AS (SELECT p.u, lo, hi, min(doc_id) FILTER (sha256 = lo) AS lo_id, min(doc_id) FILTER (sha256 = hi) AS hi_id, min(doc_id) AS original FROM p JOIN s USING (u) GROUP BY ALL),
 st AS (SELECT doc_id, CASE WHEN sha256 <> lo THEN lo_id WHEN doc_id <> lo_id THEN hi_id END AS hub FROM p JOIN l USING (u) WHERE lo <> hi),
 cl AS (SELECT node, min(row(distance, other)) AS best FROM (SELECT a AS node, b AS other, distance FROM e UNION ALL SELECT b, a, distance FROM e) GROUP BY node),
 co AS (SELECT doc_id, best[1] AS distance, best[2] AS other FROM p JOIN l USING (u) JOIN cl ON node = original WHERE lo = hi AND doc_id <> original)
 SELECT a, b, distance FROM e UNION ALL SELECT least(doc_id, hub), greatest(doc_id, hub), 0 FROM st WHERE hub IS NOT NULL UNION ALL SELECT least(doc_id, other), greatest(doc_id, other), distance FROM co""")
def _(s, d):
    return dup.near_links(prints(s, d))


@query("duplicate_clusters", CLUSTERS + " SELECT * FROM near")
def _(s, d):
    return dup.near_clusters(prints(s, d))


@query("near_flooding", CLUSTERS + """, c AS (SELECT sample_id AS node FROM near WHERE redundant) SELECT contributor, count(*) AS n, count(node) AS near, round(count(node) / count(*), 6) AS share, count(node) / count(*) >= 0.02 AS floods FROM samples LEFT JOIN c ON sample_id = node GROUP BY contributor""")
def _(s, d):
    return dup.flooding(dup.near_clusters(prints(s, d)), view(s, d, "samples"))


@query("split_leakage", CLUSTERS + """, ex AS (SELECT sha256, min(sample_id) AS first_id FROM samples GROUP BY sha256 HAVING count(*) > 1), m AS (SELECT coalesce(n.cluster, ex.first_id) AS cluster, path FROM samples LEFT JOIN near n USING (sample_id) LEFT JOIN ex USING (sha256) WHERE coalesce(n.cluster, ex.first_id) IS NOT NULL),
 x AS (SELECT cluster, CASE WHEN path LIKE '%/validation/%' THEN 'val' WHEN path LIKE '%/test/%' THEN 'test' ELSE 'train' END AS split FROM m) SELECT cluster, count(*) AS n, string_agg(DISTINCT split, ',' ORDER BY split) AS splits, count(DISTINCT split) AS n_splits FROM x GROUP BY cluster HAVING count(DISTINCT split) > 1""")
def _(s, d):
    return dup.leaks(dup.all_clusters(view(s, d, "samples"), dup.near_clusters(prints(s, d))))


@query("evaluation_contamination", """WITH sh AS (SELECT 'd' AS k, doc_id AS id, string_split(lower(text), ' ') AS w FROM documents UNION ALL SELECT 'i', item_id, string_split(lower(text), ' ') FROM benchmark),
 t AS (SELECT k, id, unnest(list_distinct(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' ')))) AS s FROM sh WHERE len(w) >= 8)
 SELECT x.id AS doc_id, y.id AS item_id, count(*) AS shared FROM t x JOIN t y ON x.k = 'd' AND y.k = 'i' AND x.s = y.s GROUP BY ALL""")
def _(s, d):
    return dup.contaminated_items(table(s, d, "documents"), table(s, d, "benchmark"))


@query("redundant_union", CLUSTERS + ", x AS (SELECT sample_id, row_number() OVER (PARTITION BY sha256 ORDER BY sample_id) AS p FROM samples) SELECT sample_id, 'exact' AS kind FROM x WHERE x.p > 1 UNION ALL SELECT sample_id, 'near' FROM near WHERE redundant")
def _(s, d):
    samples = view(s, d, "samples")
    return dup.redundant_union(dup.redundant(samples), dup.near_clusters(prints(s, d)).filter("redundant"))


@query("class_imbalance", "SELECT count(*) AS n_classes, max(n) AS max_count, min(n) AS min_count, round(max(n) / min(n), 6) AS ratio, CASE WHEN max(n) / min(n) >= 25 THEN 'HIGH' WHEN max(n) / min(n) > 8 THEN 'MEDIUM' ELSE 'INFO' END AS severity FROM (SELECT label, count(*) AS n FROM samples GROUP BY label)")
def _(s, d):
    return a.class_imbalance(view(s, d, "samples"))


@query("folder_labels", "SELECT sample_id, label, 'FOLDERS' AS layout FROM samples")
def _(s, d):
    return a.folder_labels(view(s, d, "samples"))


@query("unlabelled", "SELECT sample_id, contributor FROM samples WHERE sample_id NOT IN (SELECT doc_id FROM labels)")
def _(s, d):
    return a.unlabelled(view(s, d, "samples"), table(s, d, "labels").withColumnRenamed("doc_id", "sample_id")).select("sample_id", "contributor")


@query("contributor_resolution", "SELECT sample_id, contributor, 'HINTED_FOLDER' AS strategy FROM samples")
def _(s, d):
    samples = view(s, d, "samples")
    known = samples.filter("sample_id % 3 = 0").select(F.concat(F.col("sample_id").cast("string"), F.lit(".txt")).alias("name"), F.lit("listed").alias("contributor"))
    return a.contributor_resolution(samples, known)


@query("coco_defects", """WITH t AS (SELECT annotation_id, count(*) AS c FROM annotations GROUP BY annotation_id), x AS (SELECT n.annotation_id, CAST(annotated AS VARCHAR) AS image_id, annotated NOT IN (SELECT o_orderkey FROM orders) AS dangling, category_id >= 900 AS undeclared, c > 1 AS twice, w <= 0 OR h <= 0 AS box FROM annotations n JOIN t USING (annotation_id))
 SELECT annotation_id, image_id, 'dangling-annotation' AS defect, 'HIGH' AS severity FROM x WHERE dangling UNION ALL SELECT annotation_id, image_id, 'undeclared-category', 'HIGH' FROM x WHERE undeclared AND NOT dangling UNION ALL SELECT annotation_id, image_id, 'duplicate-annotation-id', 'MEDIUM' FROM x WHERE twice UNION ALL SELECT annotation_id, image_id, 'invalid-bbox', 'MEDIUM' FROM x WHERE box AND NOT dangling
 UNION ALL SELECT NULL, concat('x', CAST(o_orderkey AS VARCHAR)), 'non-integer-id', 'HIGH' FROM orders WHERE o_orderkey % 1000 = 3 UNION ALL SELECT NULL, CAST(o_orderkey AS VARCHAR), 'missing-image', 'MEDIUM' FROM orders WHERE o_orderkey % 200 = 5""")
def _(s, d):
    rows = view(s, d, "annotations").drop("image_id").withColumnRenamed("annotated", "image_id")
    orders = table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("images\\"), F.col("o_orderkey").cast("string"), F.lit(".jpg")).alias("file_name"))
    images = orders.union(orders.filter("id % 1000 = 3").select(F.concat(F.lit("x"), "id"), F.lit("")))
    files = orders.filter("id % 200 <> 5").select(F.concat("id", F.lit(".jpg")).alias("name"))
    return a.coco_defects(images, rows.filter("category_id < 900").select(F.col("category_id").alias("id")), rows, files)


@query("majority_label", "SELECT image_id, category_id, n FROM (SELECT image_id, category_id, count(*) AS n, row_number() OVER (PARTITION BY image_id ORDER BY count(*) DESC, category_id) AS p FROM annotations GROUP BY image_id, category_id) WHERE p = 1")
def _(s, d):
    return a.majority_label(view(s, d, "annotations"))


@query("entry_paths", "SELECT page_id, CASE WHEN url IS NULL OR trim(url) = '' THEN 'EMPTY' WHEN url LIKE '/%' OR regexp_matches(url, '^[A-Za-z]:') THEN 'ABSOLUTE' WHEN list_contains(string_split(url, '/'), '..') THEN 'TRAVERSAL' WHEN len(string_split(url, '/')) > 24 THEN 'TOO_DEEP' WHEN length(url) > 512 THEN 'TOO_LONG' END AS fault FROM pages")
def _(s, d):
    return table(s, d, "pages").select("page_id", man.path_fault(F.col("url")).alias("fault"))


@query("sniffed_formats", "SELECT page_id, CASE WHEN html LIKE '<!DO%' OR html LIKE '<htm%' THEN 'html' ELSE 'unknown' END AS format FROM pages")
def _(s, d):
    return table(s, d, "pages").select("page_id", man.sniffed(F.encode("html", "utf-8")).alias("format"))


@query("manifest_limits", """WITH f AS (SELECT archive_id, entry_no, file_size, CASE WHEN is_link THEN 'LINK' WHEN file_size > 268435456 THEN 'OVERSIZED' WHEN compressed_size > 0 AND file_size::DOUBLE / compressed_size > 200 THEN 'RATIO' END AS fault FROM manifest),
 t AS (SELECT *, CAST(sum(CASE WHEN fault IS NULL THEN file_size ELSE 0 END) OVER w AS BIGINT) AS accepted_bytes, count(*) OVER w AS c FROM f WINDOW w AS (PARTITION BY archive_id ORDER BY entry_no))
 SELECT archive_id, entry_no, fault, accepted_bytes, accepted_bytes > 2147483648 OR c > 200000 AS aborted FROM t""")
def _(s, d):
    return man.manifest_faults(view(s, d, "manifest"))


@query("evidence_contract", "WITH e AS (SELECT finding_id, severity, CASE analysis_id % 5 WHEN 4 THEN 'NONE' ELSE 'MODEL' END AS type, CASE WHEN analysis_id % 6 = 0 THEN 'xyz' ELSE sha256(finding_id) END AS digest, raw_confidence AS confidence FROM findings) SELECT finding_id, 'severity' AS rule FROM e WHERE severity = 'ODD' UNION ALL SELECT finding_id, 'type' FROM e WHERE type = 'NONE' UNION ALL SELECT finding_id, 'digest' FROM e WHERE length(digest) <> 64 UNION ALL SELECT finding_id, 'confidence' FROM e WHERE NOT confidence BETWEEN 0 AND 1")
def _(s, d):
    e = view(s, d, "findings").select("finding_id", "severity", F.when(F.col("analysis_id") % 5 == 4, "NONE").otherwise("MODEL").alias("type"), F.when(F.col("analysis_id") % 6 == 0, "xyz").otherwise(F.sha2("finding_id", 256)).alias("digest"), F.col("raw_confidence").alias("confidence"))
    return man.violations(e, man.evidence_rules(), ["finding_id"])


@query("ks_by_feature", """WITH c AS (SELECT comparison_id, feature, value, count(*) FILTER (side = 0) AS x, count(*) FILTER (side = 1) AS y FROM values GROUP BY ALL),
 g AS (SELECT comparison_id, feature, x, y, abs(sum(x) OVER u / sum(x) OVER p - sum(y) OVER u / sum(y) OVER p) AS gap FROM c WINDOW u AS (PARTITION BY comparison_id, feature ORDER BY value), p AS (PARTITION BY comparison_id, feature)),
 k AS (SELECT comparison_id, feature, max(gap) AS ks, sum(x)::DOUBLE AS n, sum(y)::DOUBLE AS m FROM g GROUP BY ALL),
 l AS (SELECT *, (sqrt(n * m / (n + m)) + 0.12::DOUBLE + 0.11::DOUBLE / sqrt(n * m / (n + m))) * ks AS lam FROM k),
 q AS (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, 2 * list_sum(list_transform(range(1, 101), lambda j: CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0::DOUBLE * j * j * lam * lam))))) AS p FROM l)
 SELECT comparison_id, feature, round(ks, 6) AS ks, round(p, 6) AS p_value, CASE WHEN p < 0.01 AND ks > 0.3 THEN 'SHIFTED' WHEN p < 0.05 THEN 'DRIFTING' ELSE 'STABLE' END AS status FROM q""")
def _(s, d):
    return sh.ks_by_feature(view(s, d, "values"))


PSI = """WITH c AS (SELECT comparison_id, side, cls, count(*)::DOUBLE AS n FROM classes GROUP BY ALL), q AS (SELECT *, n / sum(n) OVER (PARTITION BY comparison_id, side) AS ratio FROM c),
 z AS (SELECT comparison_id, cls, greatest(coalesce(max(ratio) FILTER (side = 0), 0), 1e-6) AS b, greatest(coalesce(max(ratio) FILTER (side = 1), 0), 1e-6) AS t FROM q GROUP BY ALL) """


@query("psi_by_class", PSI + "SELECT comparison_id, cls, round(b, 6) AS baseline_ratio, round(t, 6) AS target_ratio, round(t - b, 6) AS delta FROM z")
def _(s, d):
    return sh.psi_by_class(view(s, d, "classes")).drop("term")


@query("psi_total", PSI + "SELECT comparison_id, round(sum((t - b) * ln(t / b)), 6) AS psi FROM z GROUP BY comparison_id")
def _(s, d):
    return sh.psi(view(s, d, "classes"))


@query("summary_drift", """WITH m AS (SELECT comparison_id, feature, side, avg(value) AS v FROM values GROUP BY ALL), b AS (SELECT comparison_id, feature, max(v) FILTER (side = 0) AS x, max(v) FILTER (side = 1) AS y FROM m GROUP BY ALL), e AS (SELECT *, abs(y - x) / greatest(abs(x), 1e-9) AS drift FROM b WHERE x IS NOT NULL AND y IS NOT NULL)
 SELECT comparison_id, feature, round(x, 4) AS baseline_mean, round(y, 4) AS target_mean, round(drift, 6) AS drift, CASE WHEN drift > 0.2 THEN 'DRIFTED' WHEN drift > 0.08 THEN 'WATCH' ELSE 'STABLE' END AS status FROM e""")
def _(s, d):
    return sh.summary_drift(view(s, d, "values").groupBy("comparison_id", "feature", "side").agg(F.avg("value").alias("value")))


@query("gini_by_group", "WITH x AS (SELECT l_returnflag AS flag, l_extendedprice - min(l_extendedprice) OVER (PARTITION BY l_returnflag) AS x, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS i FROM lineitem) SELECT flag, round(2 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*), 6) AS gini FROM x GROUP BY flag")
def _(s, d):
    return sh.gini(table(s, d, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice"), "flag", "l_extendedprice")


@query("mad_outliers", "WITH m AS (SELECT user_id, event_id, value - median(value) OVER (PARTITION BY user_id) AS d FROM events), n AS (SELECT *, median(abs(d)) OVER (PARTITION BY user_id) AS mad FROM m) SELECT user_id, event_id, round(0.6745::DOUBLE * d / mad, 6) AS z FROM n WHERE mad > 0 AND abs(0.6745::DOUBLE * d / mad) > 3.5")
def _(s, d):
    return sh.mad_outliers(table(s, d, "events"), "user_id", "event_id", "value")


def vectors(s, d):
    e = table(s, d, "embeddings")
    label = F.when(F.col("vec_id") % 25 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return e.select(F.col("vec_id").alias("id"), label.cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("v"))


KNN = """WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 25 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding::DOUBLE[] AS v FROM embeddings),
 s AS (SELECT a.id, b.id AS other, list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)) AS similarity FROM v a JOIN v b ON a.id <> b.id),
 k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other) AS place FROM s) WHERE place <= 15) """
SUSPECTS = KNN + """, c AS (SELECT k.id, n.label AS l, count(*) AS c FROM k JOIN v n ON n.id = k.other GROUP BY ALL), t AS (SELECT c.id, sum(c.c) AS total, max(row(c.c, -c.l)) AS top, sum(CASE WHEN c.l = v.label THEN c.c ELSE 0 END) AS own FROM c JOIN v ON v.id = c.id GROUP BY c.id),
 z AS (SELECT v.id, v.label, -(top[2]) AS projected, 1 - own / total AS disagreement, top[1] / total - own / total AS margin FROM t JOIN v ON v.id = t.id), su AS (SELECT id, label, projected, round(disagreement, 6) AS disagreement, round(margin, 6) AS margin, round(least(0.99::DOUBLE, 0.5::DOUBLE + 0.5::DOUBLE * margin + 0.2::DOUBLE * (disagreement - 0.85::DOUBLE)), 6) AS confidence FROM z WHERE disagreement >= 0.85 AND margin >= 0.4 AND projected <> label)"""


@query("nearest_neighbours", KNN + "SELECT id, other, round(similarity, 6) AS similarity, place FROM k")
def _(s, d):
    return vec.nearest(vectors(s, d)).withColumn("similarity", F.round("similarity", 6))


def suspects(s, d):
    v = vec.comparable(vectors(s, d))
    return v, vec.label_suspects(v, vec.nearest(v))


@query("label_suspects", SUSPECTS + " SELECT * FROM su")
def _(s, d):
    return suspects(s, d)[1].withColumns({c: F.round(c, 6) for c in ("disagreement", "margin", "confidence")})


@query("label_flows", SUSPECTS + ", fl AS (SELECT label, projected, count(*) AS n FROM su GROUP BY ALL), cn AS (SELECT label, count(*) AS class_n FROM v GROUP BY label) SELECT label, projected, n, round(n / sum(n) OVER (), 6) AS concentration, round(n / class_n, 6) AS share, n >= 8 AND n / sum(n) OVER () >= 0.6 AND n / class_n >= 0.03 AS systematic FROM fl JOIN cn USING (label)")
def _(s, d):
    v, found = suspects(s, d)
    return vec.label_flows(found, v)


@query("mahalanobis_outliers")
def _(s, d):
    return vec.mahalanobis(vectors(s, d))


@query("mmd_permutation")
def _(s, d):
    e = table(s, d, "embeddings")
    return sh.mmd2(e.select(F.lit(1).cast("long").alias("comparison_id"), F.col("vec_id").alias("id"), (F.col("label") < 5).cast("int").alias("side"), F.col("embedding").cast("array<double>").alias("v")))


def copies(s, d):
    """Sign fingerprints and vectors of all embeddings and of planted near copies of some."""
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    some = e.filter("id % 50 = 0")
    changed = lambda by, shift: some.select((F.col("id") + shift).alias("id"), F.transform("v", lambda x, i: F.when(i == 0, x * by).otherwise(x)).alias("v"))
    return e.union(changed(0.5, 1_000_000)).union(changed(-1.0, 2_000_000))


@query("near_duplicate_vectors", """WITH p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings UNION ALL SELECT vec_id + 1000000, list_concat([embedding[1]::DOUBLE * 0.5::DOUBLE], embedding[2:]::DOUBLE[]) FROM embeddings WHERE vec_id % 50 = 0 UNION ALL SELECT vec_id + 2000000, list_concat([-embedding[1]::DOUBLE], embedding[2:]::DOUBLE[]) FROM embeddings WHERE vec_id % 50 = 0),
 q AS (SELECT id, v, list_transform(v, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits FROM p), f AS (SELECT min(id) AS id, bits, v FROM q GROUP BY bits, v),
 z AS (SELECT a.id AS a, b.id AS b, CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN a.bits[i] <> b.bits[i] THEN 1 ELSE 0 END)) AS INTEGER) AS distance, list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)) AS similarity FROM f a JOIN f b ON a.id < b.id),
 e AS (SELECT * FROM z WHERE distance <= 5 AND similarity >= 0.98), cl AS (SELECT node, min(row(distance, other, similarity)) AS best FROM (SELECT a AS node, b AS other, distance, similarity FROM e UNION ALL SELECT b, a, distance, similarity FROM e) GROUP BY node),
 co AS (SELECT q.id, best FROM q JOIN f ON q.bits = f.bits AND q.v = f.v JOIN cl ON cl.node = f.id WHERE q.id <> f.id)
 SELECT a, b, distance, round(similarity, 6) AS similarity FROM e UNION ALL SELECT least(id, best[2]), greatest(id, best[2]), best[1], round(best[3], 6) FROM co""")
def _(s, d):
    rows = copies(s, d)
    bits = F.lit(0).cast("long")
    for k in range(64):
        bits = bits.bitwiseOR(F.when(F.element_at("v", k + 1) > 0, F.lit(1 << k if k < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
    return dup.near_vectors(rows.select("id", bits.alias("fingerprint"), "v")).withColumn("similarity", F.round("similarity", 6))


@query("mask_anomalies", """WITH m AS (SELECT *, median(l1_norm) OVER p AS mid, count(*) OVER p AS c FROM masks WINDOW p AS (PARTITION BY model)), e AS (SELECT *, abs(l1_norm - mid) AS dist FROM m WHERE c >= 3), g AS (SELECT *, median(dist) OVER (PARTITION BY model) AS mad FROM e),
 h AS (SELECT *, CASE WHEN mad > 0 THEN dist / (1.4826::DOUBLE * mad) ELSE 0 END AS idx, l1_norm / mid AS ratio FROM g) SELECT model, cls, round(idx, 6) AS anomaly_index, round(ratio, 6) AS l1_ratio, attack_success >= 0.85 AND (ratio <= 0.35 OR (idx > 2 AND ratio <= 0.55)) AS flagged FROM h""")
def _(s, d):
    return mod.mask_anomalies(view(s, d, "masks"))


@query("dataset_risk", f"""WITH def AS ({DEFECTS}), x AS (SELECT contributor, count(DISTINCT s.sample_id) AS n, count(*) FILTER (kind = 'trigger') AS trig, count(*) FILTER (kind = 'label') AS lab, count(*) FILTER (kind = 'exact') AS exa FROM samples s LEFT JOIN def USING (sample_id) GROUP BY contributor)
 SELECT contributor, round(0.5::DOUBLE * least(100.0::DOUBLE, least(45.0::DOUBLE, trig / n * 1500) + CASE WHEN lab >= 8 THEN least(25.0::DOUBLE, lab / n * 250) ELSE least(8.0::DOUBLE, lab / n * 40) END + least(15.0::DOUBLE, exa / n * 60)) + 5, 4) AS risk FROM x""")
def _(s, d):
    per = r.contributor_profile(view(s, d, "samples"), defects(s, d))
    zero = F.lit(0)
    counts = per.select("contributor", "n", "trigger", "label", (F.col("label") >= 8).alias("systematic"), zero.alias("corrupt"), F.col("exact").alias("redundant"), zero.alias("ood"), zero.alias("annotation"), F.lit(1.0).alias("ratio"), F.lit(10.0).alias("finding_risk"))
    return r.dataset_risk(counts).select("contributor", F.round("risk", 4).alias("risk"))


@query("fused_confidence", "SELECT category, round(1 - product(1 - least(1.0, greatest(0.0, confidence * 0.001::DOUBLE))), 6) AS fused FROM findings GROUP BY category")
def _(s, d):
    rows = view(s, d, "findings").select("category", (F.col("confidence") * 0.001).alias("c"))
    return fin.noisy_or(rows, "category", "c").withColumn("fused", F.round("fused", 6))
