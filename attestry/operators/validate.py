"""Validation as queries: each rule gives rows (code, record_id, detail) of what breaks it.

Rules on single columns and links come first; dataset() is the whole of a dataset's validation, which compares the derived
tables with census(), the source read anew, and with what was frozen when they were written.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions.identity import IMPORTER_VERSION, SCHEMA_VERSION, record_id, table_print
from attestry.functions.text import timestamp_state
from attestry.operators.census import json_key
from attestry.operators.graph import branch_points, cycle_members, dangling_parents, link_mismatches
from attestry.operators.rounds import Once, written

#: Codes that tell what to know about a valid dataset; all others are errors.
WARNINGS = ("unknown_role", "unknown_content", "unknown_multimodal_content", "unknown_part", "missing_child_lists", "attachment_gaps", "repeated_message_ids", "missing_creation_times")
KINDS = ("conversation", "message", "attachment")


def _found(rows: DataFrame, code: str | Column, record: Column, detail: Column | None = None) -> DataFrame:
    code = F.lit(code) if isinstance(code, str) else code
    return rows.select(code.alias("code"), record.cast("string").alias("record_id"), (detail if detail is not None else F.lit(None)).cast("string").alias("detail"))


def repeated(rows: DataFrame, columns: list[str], code: str) -> DataFrame:
    """A finding for each value of the columns that several rows share."""
    some = rows.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")
    return _found(some, code, F.col(columns[0]), F.concat_ws("|", *[F.col(c).cast("string") for c in columns[1:]], F.col("n").cast("string")))


def versions(records: DataFrame) -> DataFrame:
    """Records of another schema or importer version."""
    return _found(records.where(F.col("schema_version") != SCHEMA_VERSION), "schema_version", F.col("record_id"), F.col("schema_version")).unionByName(
        _found(records.where(F.col("importer_version") != IMPORTER_VERSION), "importer_version", F.col("record_id"), F.col("importer_version"))
    )


def identities(records: DataFrame, kind: str) -> DataFrame:
    """Records whose id isn't the one of their source and pointer."""
    right = record_id(kind, F.col("provenance.source_id"), F.col("provenance.json_pointer"))
    return _found(records.where(~F.col("record_id").eqNullSafe(right)), "record_identity", F.col("record_id"), right)


def references(children: DataFrame, column: str, parents: DataFrame, code: str) -> DataFrame:
    """Records whose reference names no record of ``parents``."""
    p = parents.select(F.col("record_id").alias(column))
    return _found(children.join(p, column, "left_anti"), code, F.col("record_id"), F.col(column))


def bad_timestamps(records: DataFrame, column: str) -> DataFrame:
    return _found(records.where(timestamp_state(F.col(column)) == "invalid"), "invalid_timestamp", F.col("record_id"), F.col(column))


def census_difference(derived: DataFrame, source: DataFrame, columns: list[str], code: str = "source_coverage") -> DataFrame:
    """Rows that one of both sides has more often than the other: derived ones and those counted in the source anew."""
    extra, missing = derived.select(*columns).exceptAll(source.select(*columns)), source.select(*columns).exceptAll(derived.select(*columns))
    return _found(extra, code, F.col(columns[0]), F.lit("not in the source")).unionByName(_found(missing, code, F.col(columns[0]), F.lit("not derived")))


def expected_counts(counts: DataFrame, expected: DataFrame, code: str = "expected_count") -> DataFrame:
    """Differences of (name, n) from (name, expected); a name without rows has none."""
    joined = expected.join(counts, "name", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return _found(joined.where("n <> expected"), code, F.col("name"), F.concat_ws("/", F.col("n").cast("string"), F.col("expected").cast("string")))


def graph_rules(nodes: DataFrame, roots: list | None = None) -> DataFrame:
    """node_collision, dangling_parent, child_link, parent_link, duplicate_child and graph_cycle over nodes
    (conversation, node, parent, children_ids)."""
    twice = nodes.where(F.size("children_ids") > F.size(F.array_distinct("children_ids")))
    links = link_mismatches(nodes)
    parts = [
        repeated(nodes, ["conversation", "node"], "node_collision"),
        _found(dangling_parents(nodes, roots), "dangling_parent", F.col("conversation"), F.col("node")),
        links.select("code", F.col("conversation").cast("string").alias("record_id"), F.concat_ws("|", F.col("parent").cast("string"), F.col("child").cast("string")).alias("detail")),
        _found(twice, "duplicate_child", F.col("conversation"), F.col("node")),
        _found(cycle_members(nodes), "graph_cycle", F.col("conversation"), F.col("node")),
    ]
    return union(parts)


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def histogram(findings: DataFrame) -> DataFrame:
    return findings.groupBy("code").agg(F.count("*").alias("n"))


def _unlike(*pairs: tuple[Column, Column]) -> Column:
    """Whether any pair of columns isn't alike."""
    return reduce(lambda a, b: a | b, [~a.eqNullSafe(b) for a, b in pairs])


def _values(*names: str) -> list[tuple[Column, Column]]:
    return [(F.col(n), F.col("values")[n]) for n in names]


def broken(rows: DataFrame, rules: list[tuple[str, Column, Column]]) -> DataFrame:
    """The findings of all rules (code, condition, detail) over the columns of a record, in one pass over the records: an
    array of what each rule finds, null where it finds nothing, of which the rest is exploded."""
    found = [F.when(wrong, F.struct(F.lit(code).alias("code"), F.col("record_id").cast("string").alias("record_id"), detail.cast("string").alias("detail"))) for code, wrong, detail in rules]
    return rows.select(F.explode(F.array_compact(F.array(*found))).alias("f")).select("f.code", "f.record_id", "f.detail")


class Dataset:
    """Derived tables (normalize.Tables' names) next to the source they came from: ``raw`` are rows of
    exports.conversations(), ``sources`` rows of exports.inventory(); ``files`` and ``roots`` say what attachment roots
    hold, see normalize.resolve_attachments(); ``frozen`` is the manifest (name, records, print) and ``expected`` the
    configured counts, by name.

    Tables and census are written once. Rules on the columns of a kind of record are one pass (``checks``) over one join
    of the records with the source, their conversation or message and their segments."""

    def __init__(self, tables: dict[str, DataFrame], raw: DataFrame, sources: DataFrame, census: DataFrame, expected: dict[str, int] | None = None, frozen: dict[str, dict] | None = None, roots: DataFrame | None = None, files: DataFrame | None = None, manifest: dict | None = None):
        self.t, self.raw, self.sources = Once(tables), raw, sources
        self._census = census
        self.expected, self.frozen, self.roots, self.files, self.manifest = expected or {}, frozen or {}, roots, files, manifest or {}

    @cached_property
    def census(self) -> DataFrame:
        """The source read anew, written when a rule first asks for it."""
        return written(self._census)

    @cached_property
    def source(self) -> dict[str, DataFrame]:
        at = F.struct(F.col("source_id").alias("s"), F.col("json_pointer").alias("p"))
        own = self.census.withColumn("at", at)
        return {kind: own.where(F.col("kind") == kind).select("at", "values", "provider", "sha256", F.col("conversation_pointer").alias("c_at"), F.col("message_pointer").alias("m_at")) for kind in (*KINDS, "node", "segment", "warning", "refused")}

    def records(self, kind: str) -> DataFrame:
        return self.t[f"{kind}s"].withColumn("at", F.struct(F.col("provenance.source_id").alias("s"), F.col("provenance.json_pointer").alias("p")))

    def _wide(self, kind: str, fidelity: bool) -> DataFrame:
        """Records with what their rules look at: _known, the provider and hash of their source; and, for ``fidelity``,
        values of the source at their place, the record that they belong to and a message's segments."""
        known = self.sources.groupBy(F.col("source_id").alias("_source")).agg(F.collect_set(F.struct("provider", "sha256")).alias("_known"))
        rows = self.records(kind)
        out = rows.join(known, F.col("provenance.source_id") == F.col("_source"), "left")
        if not fidelity:
            return out
        out = out.join(self.source[kind].select("at", "values"), "at", "left")
        parent = lambda name, *columns: self.t[name].select(*columns, F.col("provenance").alias("_from"), F.lit(True).alias("_there")).dropDuplicates(["_parent"])
        if kind == "message":
            out = out.join(parent("conversations", F.col("record_id").alias("_parent"), F.col("original_id").alias("_original")), F.col("conversation_record_id") == F.col("_parent"), "left")
            segment = F.struct(F.col("segment_index").cast("int").alias("i"), "json_pointer", "text", "kind")
            texts = F.transform(F.array_sort(F.collect_list(segment)), lambda s: F.array(s["json_pointer"], s["text"], s["kind"]))
            out = out.join(self.t["segments"].groupBy(F.col("message_record_id").alias("record_id")).agg(texts.alias("_texts")), "record_id", "left")
        if kind == "attachment":
            out = out.join(parent("messages", F.col("record_id").alias("_parent"), F.col("conversation_record_id").alias("_conversation")), F.col("message_record_id") == F.col("_parent"), "left")
        return out

    def checks(self, kind: str, *groups: str) -> DataFrame:
        """The rules on a kind's columns, of the groups identity, fidelity and times."""
        nothing = F.lit(None).cast("string")
        right = record_id(kind, F.col("provenance.source_id"), F.col("provenance.json_pointer"))
        unknown = F.array(F.struct(nothing.alias("provider"), nothing.alias("sha256")))
        foreign = F.exists(F.coalesce("_known", unknown), lambda k: ~F.col("provider").eqNullSafe(k["provider"]) | ~F.col("provenance.sha256").eqNullSafe(k["sha256"]))
        version = ~F.col("schema_version").eqNullSafe(F.lit(SCHEMA_VERSION)) | ~F.col("importer_version").eqNullSafe(F.lit(IMPORTER_VERSION))
        rules = []
        if "identity" in groups:
            rules += [
                ("record_identity", ~F.col("record_id").eqNullSafe(right), right),
                ("record_version", version, nothing),
                ("provenance", foreign, F.lit("not the source's provider or hash")),
            ]
        if "fidelity" in groups:
            in_source, at_parent = F.col("values").isNotNull(), F.coalesce("_there", F.lit(False)) if kind != "conversation" else None
            changed = lambda code, detail, *pairs: (code, in_source & _unlike(*pairs), F.lit(detail))
            inside = F.startswith(F.col("at.p"), F.concat("_from.json_pointer", F.lit("/"))) if kind != "conversation" else None
            if kind == "conversation":
                roots = F.from_json(F.col("values")["root_parent_ids"], "array<string>")
                rules += [
                    changed("metadata_fidelity", "metadata changed", (json_key(F.col("raw_metadata")), F.col("values")["raw_metadata"])),
                    changed("conversation_identity", "original id changed", *_values("original_id")),
                    changed("title_fidelity", "title changed", *_values("title")),
                    changed("timestamp_fidelity", "time changed", *_values("created_at_raw", "updated_at_raw")),
                    changed("branch_selection", "selected node or roots changed", *_values("current_node_id"), (F.col("root_parent_ids"), roots)),
                ]
            elif kind == "message":
                outside = ~F.col("at.s").eqNullSafe(F.col("_from.source_id")) | ~inside
                empty = F.array().cast("array<array<string>>")
                rules += [
                    changed("raw_fidelity", "the message changed", (json_key(F.col("raw")), F.col("values")["raw"])),
                    ("conversation_reference", ~at_parent, F.col("conversation_record_id")),
                    ("conversation_membership", at_parent & ~F.col("conversation_original_id").eqNullSafe(F.col("_original")), F.lit("another conversation's id")),
                    ("conversation_membership", at_parent & outside, F.lit("outside its conversation")),
                    changed("role_fidelity", "role changed", *_values("role", "role_raw")),
                    changed("timestamp_fidelity", "time changed", *_values("created_at_raw", "updated_at_raw")),
                    changed("message_identity", "original id changed", *_values("original_id")),
                    changed("content_kind", "kind of content changed", *_values("content_kind")),
                    changed("text_fidelity", "text changed", (F.coalesce("_texts", empty), F.from_json(F.col("values")["segments"], "array<array<string>>"))),
                ]
            else:
                outside = ~F.col("at.s").eqNullSafe(F.col("_from.source_id")) | ~F.coalesce(inside, F.lit(False))
                rules += [
                    changed("attachment_fidelity", "the reference changed", (json_key(F.col("raw")), F.col("values")["raw"])),
                    ("attachment_membership", ~F.col("conversation_record_id").eqNullSafe(F.col("_conversation")), nothing),
                    ("attachment_source_membership", outside, nothing),
                    changed("attachment_kind", "kind changed", *_values("attachment_kind")),
                    changed("attachment_metadata", "name or id changed", *_values("filename", "original_id")),
                ]
        if "times" in groups and kind != "attachment":
            rules += [("invalid_timestamp", timestamp_state(F.col(c)) == "invalid", F.col(c)) for c in ("created_at_raw", "updated_at_raw")]
        rows = self.records(kind) if groups == ("times",) else self._wide(kind, "fidelity" in groups)
        return broken(rows, rules)

    def headers(self) -> DataFrame:
        """schema_version and importer_version of the manifest, source_collision, source_identity."""
        spark = self.raw.sparkSession
        wrong = [(k, str(v)) for k, v, right in (("schema_version", self.manifest.get("schema_version", SCHEMA_VERSION), SCHEMA_VERSION), ("importer_version", self.manifest.get("importer_version", IMPORTER_VERSION), IMPORTER_VERSION)) if v != right]
        right = F.concat("provider", F.lit(":"), "sha256")
        return union([
            spark.createDataFrame([(c, None, d) for c, d in wrong], "code string, record_id string, detail string"),
            repeated(self.sources, ["source_id"], "source_collision"),
            _found(self.sources.where(~F.col("source_id").eqNullSafe(right)), "source_identity", F.col("source_id"), right),
        ])

    def identity(self) -> DataFrame:
        """headers(); and of each record record_identity, record_version, provenance."""
        return union([self.headers(), *[self.checks(kind, "identity") for kind in KINDS]])

    def places(self) -> DataFrame:
        """Rows (kind, s, p, provider, derived): the places of all records, and of what the source has."""
        place = lambda df, kind, derived: df.select(F.lit(kind).alias("kind"), "at.s", "at.p", "provider", F.lit(derived).alias("derived"))
        return union([place(df, kind, d) for kind in KINDS for df, d in ((self.records(kind), 1), (self.source[kind], 0))])

    def uniqueness(self) -> DataFrame:
        """conversation_id_collision, record_id_collision, source_pointer_collision, node_collision, duplicate_child."""
        own = self.source["conversation"].select(F.col("at.s").alias("source_id"), F.col("values")["original_id"].alias("id"))
        ids = union([self.records(kind).select("record_id") for kind in KINDS])
        shared = self.places().where("derived = 1").groupBy("kind", "s", "p").agg(F.count("*").alias("n")).where("n > 1")
        places = _found(shared, "source_pointer_collision", F.col("s"), F.concat_ws("|", "p", F.col("n").cast("string")))
        nodes = self.nodes()
        twice = nodes.where(F.size("children_ids") > F.size(F.array_distinct("children_ids")))
        return union([repeated(own, ["source_id", "id"], "conversation_id_collision"), repeated(ids, ["record_id"], "record_id_collision"), places, repeated(nodes, ["conversation", "node"], "node_collision"), _found(twice, "duplicate_child", F.col("conversation"), F.col("node"))])

    def integrity(self) -> DataFrame:
        """clean_hash_mismatch, file_count: tables that aren't what was written."""
        spark = self.raw.sparkSession
        rows = []
        for name, spec in sorted(self.frozen.items()):
            table = self.t[name]
            count = table.count()
            if table_print(table) != spec["print"]:
                rows.append(("clean_hash_mismatch", name, None))
            if count != spec["records"]:
                rows.append(("file_count", name, f"{count}/{spec['records']}"))
        return spark.createDataFrame(rows, "code string, record_id string, detail string")

    def coverage(self) -> DataFrame:
        """source_coverage, provider_count, expected_count: places and numbers, counted in the source anew."""
        own = self.places()
        at = own.groupBy("kind", "s", "p").agg(F.max("derived").alias("has"), F.min("derived").alias("lacks"))
        one_sided = at.where("has = lacks")
        parts = [_found(one_sided, "source_coverage", F.concat_ws("|", "s", "p"), F.when(F.col("has") == 1, "not in the source").otherwise("not derived"))]
        named = own.where("kind <> 'attachment'").groupBy(F.concat("provider", F.lit("_"), "kind", F.lit("s")).alias("name"))
        numbers = named.agg(F.sum("derived").alias("n"), F.sum(1 - F.col("derived")).alias("expected"))
        parts.append(expected_counts(numbers.where("n > 0").select("name", "n"), numbers.where("expected > 0").select("name", "expected"), "provider_count"))
        if self.expected:
            given = self.raw.sparkSession.createDataFrame(sorted(self.expected.items()), "name string, expected long")
            parts.append(expected_counts(numbers.where("n > 0").select("name", "n"), given))
        return union(parts)

    def conversations(self) -> DataFrame:
        """metadata_fidelity, conversation_identity, title_fidelity, timestamp_fidelity, branch_selection, graph_fidelity."""
        return self.checks("conversation", "fidelity").unionByName(self.exported_graph())

    def exported_graph(self) -> DataFrame:
        """graph_fidelity."""
        node = F.struct("position", "node_id", "parent_id", "children_ids", "message_record_id", "fields")
        listed = lambda df: df.groupBy("conversation").agg(F.array_sort(F.collect_list(node)).alias("graph"))
        own = listed(self.t["nodes"].select(F.col("conversation_record_id").alias("conversation"), F.col("position").cast("int").alias("position"), "node_id", "parent_id", "children_ids", "message_record_id", json_key(F.col("node_fields")).alias("fields")))
        v = lambda n: F.col("values")[n]
        message = F.when(F.col("m_at").isNotNull(), record_id("message", F.col("at.s"), F.col("m_at")))
        source = self.source["node"].select(record_id("conversation", F.col("at.s"), F.col("c_at")).alias("conversation"), v("position").cast("int").alias("position"), v("node_id").alias("node_id"), v("parent_id").alias("parent_id"), F.from_json(v("children_ids"), "array<string>").alias("children_ids"), message.alias("message_record_id"), v("node_fields").alias("fields"))
        both = own.join(listed(source).withColumnRenamed("graph", "wanted"), "conversation", "full_outer").join(self.t["conversations"].select(F.col("record_id").alias("conversation")).distinct(), "conversation", "left_semi")
        return _found(both.where(~F.col("graph").eqNullSafe(F.col("wanted"))), "graph_fidelity", F.col("conversation"), F.lit("the exported graph changed"))

    def messages(self) -> DataFrame:
        """raw_fidelity, conversation_reference, conversation_membership, role_fidelity, timestamp_fidelity,
        message_identity, content_kind, text_fidelity, text_pointer."""
        return self.checks("message", "fidelity").unionByName(self.text_places())

    def text_places(self) -> DataFrame:
        """text_pointer."""
        at = self.t["segments"].join(self.t["messages"].select(F.col("record_id").alias("message_record_id"), "provenance").dropDuplicates(["message_record_id"]), "message_record_id")
        there = at.select(F.col("message_record_id").alias("record_id"), F.struct(F.col("provenance.source_id").alias("s"), F.col("json_pointer").alias("p")).alias("at"), "text").join(self.source["segment"].select("at", "values"), "at", "left")
        return _found(there.where(~F.col("text").eqNullSafe(F.col("values")["text"])), "text_pointer", F.col("record_id"), F.col("at.p"))

    def attachments(self) -> DataFrame:
        """attachment_fidelity, attachment_membership, attachment_source_membership, attachment_kind, attachment_metadata,
        attachment_availability."""
        return self.checks("attachment", "fidelity").unionByName(self.availability())

    def availability(self) -> DataFrame:
        """attachment_availability, where roots are known."""
        from attestry.operators.normalize import resolve_attachments

        own = self.t["attachments"]
        if "resolved_path" not in own.columns or self.roots is None:
            return self.raw.sparkSession.createDataFrame([], "code string, record_id string, detail string")
        anew = resolve_attachments(own, self.roots, self.files).select("record_id", F.col("availability").alias("_state"), F.col("resolved_path").alias("_path"), F.col("sha256").alias("_hash"))
        wrong = _unlike((F.col("availability"), F.col("_state")), (F.col("resolved_path"), F.col("_path")), (F.col("sha256"), F.col("_hash")))
        return broken(own.join(anew, "record_id"), [("attachment_availability", wrong, F.lit("availability changed"))])

    def timestamps(self) -> DataFrame:
        """invalid_timestamp."""
        return union([self.checks(kind, "times") for kind in ("conversation", "message")])

    def nodes(self) -> DataFrame:
        n = self.t["nodes"].select(F.col("conversation_record_id").alias("conversation"), F.col("node_id").alias("node"), F.col("parent_id").alias("parent"), "position", "children_ids", "message_record_id")
        return n

    def graph(self) -> DataFrame:
        """missing_current_node, dangling_parent, child_link, parent_link, node_message_link, graph_cycle,
        conversation_message_count."""
        n = self.nodes()
        chosen = self.t["conversations"].where("current_node_id is not null").select(F.col("record_id").alias("conversation"), F.col("current_node_id").alias("node"))
        roots = self.t["conversations"].select(F.col("record_id").alias("conversation"), F.explode("root_parent_ids").alias("parent"))
        links = link_mismatches(n)
        said = n.where("message_record_id is not null")
        m = self.t["messages"].select(F.col("record_id").alias("message_record_id"), F.struct(F.col("conversation_record_id").alias("conversation"), F.col("node_id").alias("node"), F.col("parent_id").alias("parent"), F.col("position").cast("int").alias("position")).alias("_link")).dropDuplicates(["message_record_id"])
        linked = said.join(m, "message_record_id", "left").where(~F.struct("conversation", "node", "parent", F.col("position").cast("int").alias("position")).eqNullSafe(F.col("_link")))
        count = said.groupBy(F.col("conversation").alias("record_id")).agg(F.count("*").alias("n"))
        counted = self.t["conversations"].select("record_id", "message_count").join(count, "record_id", "left").where("coalesce(n, 0) <> message_count")
        return union([
            _found(chosen.join(n.select("conversation", "node"), ["conversation", "node"], "left_anti"), "missing_current_node", F.col("conversation"), F.col("node")),
            _found(dangling_parents(n).join(roots, ["conversation", "parent"], "left_anti"), "dangling_parent", F.col("conversation"), F.col("node")),
            links.select("code", F.col("conversation").alias("record_id"), F.concat_ws("|", "parent", "child").alias("detail")),
            _found(linked, "node_message_link", F.col("conversation"), F.col("node")),
            _found(cycle_members(n), "graph_cycle", F.col("conversation"), F.col("node")),
            _found(counted, "conversation_message_count", F.col("record_id"), F.concat_ws("/", F.coalesce("n", F.lit(0)), "message_count")),
        ])

    def warnings(self) -> DataFrame:
        """unknown_role, unknown_content, unknown_multimodal_content, unknown_part by message; and, one row each where
        they apply, missing_child_lists, attachment_gaps, repeated_message_ids, missing_creation_times (detail: how many)."""
        own = self.source["warning"].select(F.col("values")["code"].alias("code"), record_id("message", F.col("at.s"), F.col("m_at")).alias("record_id"), F.lit(None).cast("string").alias("detail"))
        one = lambda code, rows: rows.agg(F.count("*").alias("n")).where("n > 0").select(F.lit(code).alias("code"), F.lit(None).cast("string").alias("record_id"), F.col("n").cast("string").alias("detail"))
        times = self.t["conversations"].select("created_at_raw").unionByName(self.t["messages"].select("created_at_raw"))
        return union([
            own,
            one("missing_child_lists", self.t["nodes"].where("children_ids is null")),
            one("attachment_gaps", self.t["attachments"].where(F.col("availability").isin("unverified_reference", "missing"))),
            one("repeated_message_ids", repeated_ids(self.t["messages"])),
            one("missing_creation_times", times.where("created_at_raw is null")),
        ])

    def refused(self) -> DataFrame:
        """validation_exception: what neither the adapters nor the census can read."""
        return _found(self.source["refused"], "validation_exception", F.concat_ws("|", "at.s", "at.p"), F.col("values")["error"])

    def findings(self) -> DataFrame:
        """All rules' rows; an empty dataset of an empty source has none."""
        of_columns = [self.checks(kind, "identity", "fidelity", "times") for kind in KINDS]
        across = (self.headers, self.uniqueness, self.integrity, self.coverage, self.exported_graph, self.text_places, self.availability, self.graph, self.warnings, self.refused)
        return union([*of_columns, *[g() for g in across]])

    def errors(self) -> DataFrame:
        return self.findings().where(~F.col("code").isin(*WARNINGS))


def repeated_ids(messages: DataFrame) -> DataFrame:
    """Rows (provider, original_id, memberships) of message ids that stand in several places."""
    return messages.groupBy("provider", "original_id").agg(F.count("*").alias("memberships")).where("memberships > 1")


def statistics(tables: dict[str, DataFrame], census: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows (statistic, value, n): roles, kinds of content and of blocks, availability, missing times, transcriptions,
    texts that differ from their blocks, messages without text, empty conversations, branch points, graph nodes, nodes
    without child lists, repeated ids, payloads, places and exact duplicates."""
    by = lambda df, name, value: df.groupBy(value.alias("value")).agg(F.count("*").alias("n")).select(F.lit(name).alias("statistic"), "value", "n")
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("statistic"), F.lit("all").alias("value"), "n")
    m, n, c = tables["messages"], tables["nodes"], tables["conversations"]
    own = census.where("kind = 'message'")
    nodes = n.select(F.col("conversation_record_id").alias("conversation"), F.col("node_id").alias("node"), F.col("parent_id").alias("parent"))
    there = branch_points(nodes).join(nodes.select("conversation", "node"), ["conversation", "node"], "left_semi")
    places = sources.select(F.size("locations").alias("k"))
    total = places.agg(F.count("*").alias("a"), F.coalesce(F.sum("k"), F.lit(0)).alias("b"))
    return union([
        by(m, "role", F.col("role")),
        by(m.where("provider = 'chatgpt'"), "chatgpt_content", F.col("content_kind")),
        by(tables["segments"], "segment", F.col("kind")),
        by(tables["attachments"], "attachment", F.col("availability")),
        *[one(df.where(f"{col} is null"), f"missing_{col}_{name}") for name, df in (("conversations", c), ("messages", m)) for col in ("created_at_raw", "updated_at_raw")],
        one(own.where(F.col("values")["text_differs"] == "true"), "text_differs_from_blocks"),
        one(own.where(F.col("values")["no_text"] == "true"), "messages_without_text"),
        one(c.where("message_count = 0"), "empty_conversations"),
        one(there, "branch_points"),
        one(n, "graph_nodes"),
        one(n.where("children_ids is null"), "nodes_without_child_lists"),
        one(repeated_ids(m), "repeated_message_ids"),
        total.select(F.expr("stack(3, 'source_payloads', a, 'source_locations', b, 'duplicate_locations', b - a) as (statistic, n)")).select("statistic", F.lit("all").alias("value"), "n"),
    ])
