"""Checks between tables: freezes against files, expansions against baselines, suites against registries, submissions, intakes, campaigns.

Every check returns its findings as rows; nothing found means that it holds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillforge.functions import hashing as hs
from quillforge.functions import text as tx

#: What a source's status must start with, and which one a default suite takes.
REMOTE_PREFIX, CANDIDATE = "remote-evaluation-", "remote-evaluation-candidate-not-approved"


def _problems(rules: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules)))


def lock_mismatches(lock: DataFrame, files: DataFrame) -> DataFrame:
    """(id, kind, problem) of a lock's samples against files (path, sha256): unsafe path, missing file, other content.

    ``lock``: id and, for source, ground_truth and layout_ground_truth, the path and <kind>_sha256. A kind without a path isn't checked.
    """
    kinds = ("source", "ground_truth", "layout_ground_truth")
    entry = lambda k: F.struct(F.lit(k).alias("kind"), F.col(k).alias("path"), F.col(f"{k}_sha256").alias("expected"))
    each = lock.select("id", F.explode(F.array(*(entry(k) for k in kinds))).alias("e")).select("id", "e.*").where("path is not null")
    found = each.join(files.select("path", F.col("sha256").alias("actual")), "path", "left")
    problem = F.when(~tx.safe_relative(F.col("path")), "unsafe path").when(F.col("actual").isNull(), "missing").when(~F.col("actual").eqNullSafe(F.col("expected")), "sha256 mismatch")
    return found.select("id", "kind", problem.alias("problem")).where("problem is not null")


def freeze_binding(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Problems of two single-row reports (lock_sha256, frozen_manifest_sha256, both null where a report has none): one side unbound, a hash missing, other test sets."""
    keys = ("lock_sha256", "frozen_manifest_sha256")
    one = baseline.select(*(F.col(k).alias(f"b_{k}") for k in keys)).join(F.broadcast(candidate.select(*(F.col(k).alias(f"c_{k}") for k in keys))), F.lit(True))  # single rows
    there = lambda s: reduce(Column.__or__, (F.col(f"{s}_{k}").isNotNull() for k in keys))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    bound = there("b") & there("c")
    rules = [("one report is not bound", there("b") != there("c"))]
    for k in keys:
        rules += [(f"{k} missing", bound & (blank(f"b_{k}") | blank(f"c_{k}"))), (f"{k} differs", bound & ~blank(f"b_{k}") & ~blank(f"c_{k}") & (F.col(f"b_{k}") != F.col(f"c_{k}")))]
    return one.select(F.explode(_problems(rules)).alias("problem"))


# --- training sets -------------------------------------------------------------------------------------------------------


def identities(samples: DataFrame) -> DataFrame:
    """``samples`` (ord, id, text, sha256) with the normalized text; what breaks identity is listed in ``problems``."""
    plain = samples.withColumn("plain", tx.normalize_text(F.col("text")))
    times = F.count("*").over(Window.partitionBy("id"))
    rules = [("no id", F.coalesce(F.col("id"), F.lit("")) == ""), ("duplicate id", times > 1), ("no pinned hash", ~F.coalesce(hs.is_sha256(F.col("sha256")), F.lit(False))), ("empty text", F.coalesce(F.col("plain"), F.lit("")) == "")]
    return plain.withColumn("problems", _problems(rules))


def ordered_fingerprint(samples: DataFrame) -> DataFrame:
    """One row: SHA-256 over the framed compact JSON records [id, text, hash] in order of ``ord``.

    A digest over an order is sequential: one row holds the framed records, so it is for manifests (a hash and a line
    of text each), not for corpora; ``hashing.set_fingerprint`` parts the work.
    """
    record = hs.json_array(F.col("id"), F.col("plain"), F.col("sha256"))
    parts = F.array_sort(F.collect_list(F.struct("ord", hs.framed(record).alias("r"))))
    joined = F.aggregate(parts, F.lit(b""), lambda acc, p: F.concat(acc, p["r"]))
    return samples.agg(F.count("*").alias("samples"), F.sha2(joined, 256).alias("fingerprint"))


def expansion_findings(baseline: DataFrame, expanded: DataFrame) -> DataFrame:
    """(problem, id) of an expanded training set against its baseline.

    Both: ord, id, plain, sha256, split (train or dev). Baseline samples must all be there, unchanged; the dev samples must be the same in
    the same order; training samples must be added; no text or image of the expanded training set may be in its dev set; no character may be new or gone.
    """
    b = baseline.select("id", F.struct("plain", "sha256").alias("was"))
    e = expanded.select("id", F.struct("plain", "sha256").alias("now"))
    found = [
        b.join(e, "id", "left_anti").select(F.lit("baseline sample missing").alias("problem"), "id"),
        b.join(e, "id").where("was <> now").select(F.lit("baseline sample changed").alias("problem"), "id"),
    ]
    dev = lambda rows, name: rows.where("split = 'dev'").select(F.row_number().over(Window.partitionBy("split").orderBy("ord")).alias("place"), F.col("id").alias(name))
    both = dev(baseline, "a").join(dev(expanded, "b"), "place", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    found.append(both.select(F.lit("development split changed").alias("problem"), F.coalesce("a", "b").alias("id")))
    n = lambda rows: rows.agg(F.count_if(F.col("split") == "train").alias("n"))
    more = n(expanded).join(F.broadcast(n(baseline).withColumnRenamed("n", "m")), F.lit(True)).where("n <= m")  # single rows
    found.append(more.select(F.lit("no training sample added").alias("problem"), F.lit(None).cast("string").alias("id")))
    for column, name in (("plain", "text in training and development"), ("sha256", "image in training and development")):
        train = expanded.where("split = 'train'").select(column).distinct()
        found.append(expanded.where("split = 'dev'").join(train, column, "left_semi").select(F.lit(name).alias("problem"), "id"))
    chars = lambda rows: rows.select(F.explode(F.array_distinct(F.split("plain", ""))).alias("c")).where("c <> ''").distinct()
    a, z = chars(baseline), chars(expanded)
    changed = a.join(z, "c", "left_anti").unionByName(z.join(a, "c", "left_anti"))
    found.append(changed.select(F.lit("vocabulary changed").alias("problem"), F.col("c").alias("id")))
    return reduce(DataFrame.unionByName, found)


def expansion_sizes(baseline: DataFrame, expanded: DataFrame) -> DataFrame:
    """One row: samples and different texts of both training sets and how many were added."""
    of = lambda rows, k: rows.agg(F.count_if(F.col("split") == "train").alias(f"{k}_train"), F.count_if(F.col("split") == "dev").alias(f"{k}_dev"), F.countDistinct(F.when(F.col("split") == "train", F.col("plain"))).alias(f"{k}_texts"))
    texts = lambda rows: rows.where("split = 'train'").select("plain").distinct()
    added = texts(expanded).join(texts(baseline), "plain", "left_anti").agg(F.count("*").alias("added_texts"))
    one = of(baseline, "baseline").join(F.broadcast(of(expanded, "expanded")), F.lit(True)).join(F.broadcast(added), F.lit(True))  # single rows
    return one.withColumn("added_train", F.col("expanded_train") - F.col("baseline_train"))


def holdout_findings(evaluation: DataFrame, excluded: list[DataFrame], vocabulary: DataFrame) -> DataFrame:
    """(problem, id) of an evaluation set (id, plain, sha256) against the union of earlier sets and a vocabulary (char)."""
    prior = reduce(DataFrame.unionByName, (d.select("plain", "sha256") for d in excluded))
    found = [evaluation.join(prior.select(c).distinct(), c, "left_semi").select(F.lit(name).alias("problem"), "id") for c, name in (("plain", "text seen before"), ("sha256", "image seen before"))]
    twice = evaluation.groupBy("sha256").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n > 1")
    found.append(twice.select(F.lit("image twice").alias("problem"), "id"))
    chars = evaluation.select("id", F.explode(F.array_distinct(F.split("plain", ""))).alias("char")).where("char <> ''")
    found.append(chars.join(vocabulary.select("char"), "char", "left_anti").select(F.lit("character outside the vocabulary").alias("problem"), "id").distinct())
    return reduce(DataFrame.unionByName, found)


# --- sources and suites --------------------------------------------------------------------------------------------------


def registry_sources(registry: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Remote sources (status starts with the remote prefix): all of them, or those of ``wanted`` (ord, id) in that order, each once.

    Wanted ids that are unknown or not remote come with a problem.
    """
    remote = F.coalesce(F.col("status"), F.lit("")).startswith(REMOTE_PREFIX)
    if wanted is None:
        return registry.where(remote).withColumn("problem", F.lit(None).cast("string"))
    first = wanted.groupBy("id").agg(F.min("ord").alias("ord"))
    known = registry.withColumn("there", F.lit(True))
    problem = F.when(F.col("there").isNull(), "unknown id").when(~remote, "not a remote source")
    return first.join(known, "id", "left").withColumn("problem", problem).drop("there")


def suite_problems(entries: DataFrame, registry: DataFrame) -> DataFrame:
    """(id, problem) of suite entries (id, pages, expected_text_layer) against the registry (id, status, text_layer, pages)."""
    known = registry.select("id", "status", "text_layer", F.col("pages").alias("page_count"), F.lit(True).alias("there"))
    both = entries.join(known, "id", "left")
    there, counted = F.col("there").isNotNull(), F.coalesce(F.col("page_count") >= 1, F.lit(False))
    rules = [
        ("unknown id", ~there),
        ("status is not a candidate's", there & ~F.col("status").eqNullSafe(F.lit(CANDIDATE))),
        ("text layer changed", there & ~F.col("text_layer").eqNullSafe(F.col("expected_text_layer"))),
        ("no page count", there & ~counted),
        ("page out of range", there & counted & F.exists("pages", lambda p: p > F.col("page_count"))),
    ]
    return both.select("id", F.explode(_problems(rules)).alias("problem"))


# --- intake, captures, submissions ---------------------------------------------------------------------------------------


def intake(existing: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` (id, document_id, split or null) with the split it gets and its problem, if any.

    A document keeps the split it has; else the one asked for; else one by its hash. Ids must be new, a split that is asked for must
    not differ from the document's, a document with several splits is refused.
    """
    per = existing.groupBy("document_id").agg(F.min("split").alias("has"), F.countDistinct("split").alias("splits"))
    ids = existing.select("id").distinct().withColumn("taken", F.lit(True))
    both = new.join(per, "document_id", "left").join(ids, "id", "left")
    problem = F.when(F.col("taken"), "id exists").when(F.col("splits") > 1, "document in several splits").when(F.col("split").isNotNull() & F.col("has").isNotNull() & (F.col("split") != F.col("has")), "document is in another split")
    chosen = F.coalesce("has", "split", hs.stable_split(F.col("document_id").cast("string")))
    return both.select(*new.columns, chosen.alias("chosen"), problem.alias("problem"))


def capture_files(files: DataFrame, pages: DataFrame, extensions: list[str]) -> DataFrame:
    """Which page each file (name, decoded: the id of its mark, or null) shows, by mark or by name, and what is wrong with it.

    ``pages``: page, requires_mark. Files of other kinds are ignored. Two files of one page are both wrong.
    """
    stem, ext = F.regexp_extract("name", r"^(.+?)(\.[^.]*)?$", 1), F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1))
    rows = files.select("name", "decoded", stem.alias("stem"), ext.isin(extensions).alias("taken"))
    by_mark, by_name = pages.select(F.col("page").alias("decoded"), F.lit(True).alias("mark_known")), pages.select(F.col("page").alias("stem"), F.lit(True).alias("name_known"), "requires_mark")
    rows = rows.join(by_mark, "decoded", "left").join(by_name, "stem", "left")
    page = F.when(F.col("decoded").isNotNull(), F.col("decoded")).when(F.col("name_known"), F.col("stem"))
    problem = (
        F.when(F.col("decoded").isNotNull() & F.col("mark_known").isNull(), "mark of another suite")
        .when(F.col("decoded").isNotNull() & F.col("name_known") & (F.col("stem") != F.col("decoded")), "name and mark differ")
        .when(F.col("decoded").isNull() & F.col("name_known") & F.col("requires_mark"), "mark not readable")
        .when(F.col("decoded").isNull() & F.col("name_known").isNull(), "unknown page")
    )
    named = rows.where("taken").select("name", page.alias("page"), F.when(F.col("decoded").isNotNull(), "mark").otherwise("name").alias("method"), problem.alias("problem"))
    several = F.count("page").over(Window.partitionBy("page")) > 1
    return named.withColumn("problem", F.coalesce("problem", F.when(F.col("page").isNotNull() & several, "several files of a page")))


def capture_plan(pages: DataFrame, captures: DataFrame, existing: DataFrame, capture_id: str) -> DataFrame:
    """(page, problem) of a planned registration: pages without a capture, sample ids (page-capture) that exist, captures that are blank or digital copies.

    ``captures``: page, visible, digital_copy; ``existing``: id.
    """
    missing = pages.join(captures, "page", "left_anti").select("page", F.lit("missing").alias("problem"))
    ids = captures.withColumn("id", F.concat("page", F.lit(f"-{capture_id}")))
    taken = ids.join(existing.select("id").distinct(), "id", "left_semi").select("page", F.lit("sample exists").alias("problem"))
    odd = captures.select("page", F.explode(_problems([("too little content", ~F.col("visible")), ("digital copy", F.col("digital_copy"))])).alias("problem"))
    return missing.unionByName(taken).unionByName(odd)


#: How alike a capture and the digital page may be, and how much content it must show.
ASPECT, MAE, DHASH, INK = 0.005, 3.0, 2, 0.003


def authenticity(aspect_delta: Column, mae: Column, hash_a: Column, hash_b: Column, ink: Column) -> Column:
    """(distance, digital_copy, visible) from measured columns: a copy agrees in shape, in grey values and in its 64-bit difference hash."""
    distance = F.bit_count(hash_a.bitwiseXOR(hash_b))
    return F.struct(distance.alias("distance"), ((aspect_delta <= ASPECT) & (mae <= MAE) & (distance <= DHASH)).alias("digital_copy"), (ink >= INK).alias("visible"))


def submission_problems(members: DataFrame, sums: DataFrame, records: DataFrame, extensions: list[str]) -> DataFrame:
    """(subject, problem) of a submitted package.

    ``members``: name, size, sha256 of what it holds; ``sums``: name, digest of its checksum file; ``records``: page_id, filename, member,
    size_bytes, sha256 of its manifest. Checksums must cover the members but their own file, exactly; records must name every capture once.
    """
    own, front = "SHA256SUMS", "capture-submission.json"
    listed = members.groupBy("name").agg(F.count("*").alias("n"), F.max("size").alias("size"), F.max("sha256").alias("actual"))
    digests = sums.groupBy("name").agg(F.count("*").alias("times"), F.max(F.lower("digest")).alias("digest"))
    both = listed.where(F.col("name") != own).join(digests, "name", "full_outer")
    rules = [
        ("duplicate member", F.col("n") > 1),
        ("unsafe member", ~tx.safe_relative(F.col("name"))),
        ("no checksum", F.col("digest").isNull()),
        ("checksum without member", F.col("n").isNull()),
        ("duplicate checksum", F.col("times") > 1),
        ("bad digest", F.col("digest").isNotNull() & ~hs.is_sha256(F.col("digest"))),
        ("checksum mismatch", F.col("actual") != F.col("digest")),
    ]
    found = [both.select(F.col("name").alias("subject"), F.explode(_problems(rules)).alias("problem"))]
    need = members.sparkSession.createDataFrame([(own,), (front,)], "name string")
    found.append(need.join(members, "name", "left_anti").select(F.col("name").alias("subject"), F.lit("required file missing").alias("problem")))
    times = F.count("*").over(Window.partitionBy("page_id"))
    stem, ext = F.regexp_extract("filename", r"^(.+?)(\.[^.]*)?$", 1), F.lower(F.regexp_extract("filename", r"(\.[^.]*)$", 1))
    rec = records.withColumn("times", times).join(listed.select(F.col("name").alias("member"), F.col("size").alias("has_size"), "actual"), "member", "left")
    shape = (F.col("member") == F.concat(F.lit("captures/"), F.col("filename"))) & ~F.col("filename").contains("/") & (stem == F.col("page_id")) & ext.isin(extensions)
    rules = [
        ("unsafe page id", ~F.col("page_id").rlike(r"^[A-Za-z0-9._-]+\z")),
        ("page twice", F.col("times") > 1),
        ("bad member name", ~shape),
        ("capture missing", F.col("actual").isNull()),
        ("capture differs", (F.col("has_size") != F.col("size_bytes")) | (F.col("actual") != F.lower("sha256"))),
    ]
    found.append(rec.select(F.col("page_id").alias("subject"), F.explode(_problems(rules)).alias("problem")))
    loose = listed.where(F.col("name").startswith("captures/")).join(records.select(F.col("member").alias("name")), "name", "left_anti")
    found.append(loose.select(F.col("name").alias("subject"), F.lit("capture without record").alias("problem")))
    return reduce(DataFrame.unionByName, found)


def capture_modes(tags: Column, subset: Column, fallback: dict[str, str]) -> Column:
    """Modes from tags "capture:<mode>", sorted; without any, the mode that the subset stands for, if one does."""
    marked = F.transform(F.filter(tags, lambda t: t.startswith("capture:")), lambda t: F.substring(t, 9, 10**6))
    names = F.create_map(*(x for k, v in fallback.items() for x in (F.lit(k), F.lit(v))))
    other = F.array_compact(F.array(F.try_element_at(names, subset)))
    return F.when(F.size(marked) > 0, F.array_sort(F.array_distinct(marked))).otherwise(other)


def registered(samples: DataFrame, pages: DataFrame) -> DataFrame:
    """One row: samples whose document is a page of the suite, and the unexpected others."""
    known = pages.select(F.col("page").alias("document_id")).distinct().withColumn("there", F.lit(True))
    return samples.join(known, "document_id", "left").agg(F.count_if("there").alias("registered"), F.count_if(F.col("there").isNull()).alias("unexpected"))


def sample_offsets(lines: DataFrame, variants: int) -> DataFrame:
    """``lines`` (part, pos, text) that aren't blank, with the number of their first generated sample: lines before them in order times ``variants``.

    Counted by parts first, so no task holds more than a part; ``part`` doesn't decrease along the corpus.
    """
    solid = lines.where(F.trim("text") != "")
    counts = solid.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # one row a part
    inner = F.row_number().over(Window.partitionBy("part").orderBy("pos")) - 1
    return solid.withColumn("inner", inner).join(before, "part").withColumn("first_sample", (F.col("before") + F.col("inner")) * variants).drop("before", "inner")
