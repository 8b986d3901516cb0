"""Whether a run is what it says it is: equality gates over protocol, profile and decision, the run's identity, intents and receipts held
against it, and reports held against each other. All give violations (rule, key), none if all is well; a value that is missing breaks its rule.

Documents are JSON texts in columns, one row for each run, so a table of runs is judged as one is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.functions.canonical import canonical, digest, run_id
from gradewell.operators.episode_runs import run_episodes
from gradewell.operators.journal import digest_faults
from gradewell.schemas import FAULT, STATUS


def at(document: str, path: str) -> Column:
    return F.get_json_object(document, f"$.{path}")


def same(actual: Column, expected: Column) -> Column:
    return F.coalesce(actual == expected, F.lit(False))


def _object(text: Column) -> Column:
    """The entries of a flat JSON object in order of their keys, numbers as numbers."""
    entries = F.map_entries(F.from_json(text, "map<string,string>"))
    return F.array_sort(F.transform(entries, lambda e: F.struct(e["key"].alias("key"), F.coalesce(e["value"].try_cast("double").cast("string"), e["value"]).alias("value"))))


# What a decision that qualifies says.
PASSED, QUALIFIED = "PASS", "A_EXACT_PROFILE_QUALIFIES"


def input_rules(pins: dict[str, str], cases: int = 4) -> dict[str, Column]:
    """Over protocol, profile and decision (JSON), and protocol_sha256 and lock_sha256, the digests of two files. pins: repository, revision,
    prompt_version and attention_mode that this build is for."""
    pin = {k: F.lit(v) for k, v in pins.items()}
    override = "runtime_override"
    return {
        "parent protocol hash": same(at("profile", "parent_protocol_sha256"), F.col("protocol_sha256")),
        "parent protocol id": same(at("profile", "parent_protocol_id"), at("protocol", "protocol_id")),
        "decision": same(at("decision", "decision"), F.lit(PASSED)),
        "pass flag": same(at("decision", "kq0_pass"), F.lit("true")),
        "outcome": same(at("decision", "outcome"), F.lit(QUALIFIED)),
        "runtime profile": same(at("decision", "runtime_profile_id"), at("profile", "profile_id")),
        "protocol repository": same(at("protocol", "model.repository"), pin["repository"]),
        "protocol revision": same(at("protocol", "model.revision"), pin["revision"]),
        "decision repository": same(at("decision", "model_identity.repository"), pin["repository"]),
        "decision revision": same(at("decision", "model_identity.revision"), pin["revision"]),
        "prompt version": same(at("protocol", "prompt.version"), pin["prompt_version"]),
        "protocol attention mode": same(at("protocol", "model.attention_mode"), pin["attention_mode"]),
        "decision attention mode": same(at("decision", "runtime.attention_mode"), pin["attention_mode"]),
        "generation": same(_object(at("profile", "frozen_contract_preserved.generation")), _object(at("protocol", "generation"))),
        "runtime device": same(at("profile", f"{override}.device"), at("decision", "runtime.device")),
        "runtime dtype": same(at("profile", f"{override}.checkpoint_parameter_dtype"), at("decision", "runtime.checkpoint_parameter_dtype")),
        "runtime version": same(at("profile", f"{override}.torch_version"), at("decision", "runtime.torch_version")),
        "environment lock": same(at("profile", "provenance.environment_lock_sha256"), F.col("lock_sha256")),
        "case count": same(F.size(F.from_json(at("protocol", "case_ids"), "array<string>")), F.lit(cases)),
    }


#: What a run is, in alphabetical order, so that its JSON is canonical.
GENERATION = "struct<max_new_tokens:bigint,seed:bigint,temperature:double,top_p:double,wall_clock_timeout_seconds:double>"
RUNTIME = (
    "struct<accelerator:string,attention_mode:string,autocast_used:boolean,bf16_without_emulation:boolean,cuda_visible_devices:string,device:string,environment_lock_sha256:string,kq0_checksums_v2_sha256:string,"
    "kq0_decision_sha256:string,model_identity_sha256:string,model_repository:string,model_revision:string,multi_gpu_execution_used:boolean,native_hardware_bf16_claimed:boolean,parameter_dtype:string,"
    "parent_runtime:string,precision_conversion_used:boolean,profile_id:string,python_version:string,torch_version:string,weight_sha256:string>"
)
CASES = "array<struct<case_id:string,case_sha256:string,family_id:string,prompt_sha256:string>>"


def run_identity(cases: Column, commit: Column, generation: Column, prompt_version: Column, protocol_id: Column, protocol_sha256: Column, runtime: Column, dataset_sha256: Column) -> Column:
    """struct<identity_sha256, run_id> of what a run executes: the digest of its canonical JSON, and a name made of the first 16 digits."""
    payload = F.struct(
        cases.cast(CASES).alias("cases"), commit.alias("execution_commit"), generation.cast(GENERATION).alias("generation"), prompt_version.alias("prompt_version"), protocol_id.alias("protocol_id"),
        protocol_sha256.alias("protocol_sha256"), runtime.cast(RUNTIME).alias("runtime"), dataset_sha256.alias("selected_dataset_sha256"),
    )
    sha = digest(F.concat(canonical(payload), F.lit("\n")))
    return F.struct(sha.alias("identity_sha256"), F.concat_ws("-", protocol_id, F.substring(sha, 1, 16)).alias("run_id"))


def run_name(prefix: str, sha: Column) -> Column:
    return run_id(prefix, sha, 16)


_RUN = ("run_id", "implementation_commit", "protocol_sha256")


def _against(rows: DataFrame, manifest: dict[str, Column], identities: DataFrame, case: Column, rules: dict[str, Column]) -> DataFrame:
    known = identities.select(*[F.col(c).alias(f"__{c}") for c in ("case_id", "family_id", "case_sha256", "prompt_sha256")])
    joined = rows.join(known, case == F.col("__case_id"), "left")
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(rule)) for rule, ok in rules.items()]), lambda r: r.isNotNull())
    return joined.select(F.explode(broken).alias("rule"), case.alias("key"))


def intent_faults(intents: DataFrame, manifest: dict[str, Column], identities: DataFrame) -> DataFrame:
    """Intents against the run and the case that they were written for. manifest: the run's run_id, identity_sha256, implementation_commit
    and protocol_sha256; identities: case_id, family_id, case_sha256, prompt_sha256. An intent of no known case breaks `case_id`."""
    rules = {c: same(F.col(c), manifest[c]) for c in (*_RUN, "identity_sha256")} | {c: same(F.col(c), F.col(f"__{c}")) for c in ("case_id", "family_id", "case_sha256")}
    return _against(intents, manifest, identities, F.col("case_id"), rules)


def receipt_faults(receipts: DataFrame, manifest: dict[str, Column], identities: DataFrame) -> DataFrame:
    """Receipts likewise; what was observed is compared where it was: manifest also has device, parameter_dtype and attention_mode."""
    seen = lambda c, expected: F.col(f"observation.{c}").isNull() | (F.col(f"observation.{c}") == expected)
    rules = {c: same(F.col(c), manifest[c]) for c in _RUN} | {"case_sha256": same(F.col("case_sha256"), F.col("__case_sha256"))}
    rules |= {c: same(F.col(f"attempt.{c}"), F.col(f"__{c}")) for c in ("case_id", "family_id")}
    rules |= {"prompt_sha256": seen("prompt_sha256", F.col("__prompt_sha256")), "runtime_device": seen("runtime_device", manifest["device"])}
    rules |= {c: seen(c, manifest[c]) for c in ("parameter_dtype", "attention_mode")}
    return _against(receipts, manifest, identities, F.col("attempt.case_id"), rules)


def live_rules(live: dict[str, Column], wanted: dict[str, Column]) -> dict[str, Column]:
    """What runs now against what was qualified; live: python_version, torch_version, cuda_visible_devices, cuda_available, device_count, accelerator."""
    rules = {c: same(live[c], wanted[c]) for c in ("python_version", "torch_version", "cuda_visible_devices")}
    return rules | {"cuda_available": live["cuda_available"], "device_count": live["device_count"] == 1, "accelerator": F.contains(live["accelerator"], wanted["accelerator"])}


def revision_rules(pins: dict[str, str]) -> dict[str, Column]:
    """The first gate, over the column identity (JSON): the revisions of primary_model, base_comparator and upstream_gguf."""
    return {part: same(at("identity", f"{part}.revision"), F.lit(revision)) for part, revision in pins.items()}


def integrity_faults(records: DataFrame, files: DataFrame, wanted: DataFrame) -> DataFrame:
    """records (file, local_sha256, upstream_sha256, matches_upstream) against files (path, sha256), of the files that are wanted (path,
    verified). Verified ones must match upstream; others have no upstream digest; all of these are there as they were recorded."""
    some = wanted.join(records.withColumnRenamed("file", "path"), "path", "left")
    local = digest_faults(some.select("path", F.col("local_sha256").alias("sha256")), files.join(wanted, "path", "left_semi"))
    upstream = some.where(F.when(F.col("verified"), ~F.coalesce("matches_upstream", F.lit(False))).otherwise(F.col("upstream_sha256").isNotNull()))
    return local.select(F.col("fault").alias("rule"), F.col("path").alias("key")).union(upstream.select(F.lit("upstream").alias("rule"), F.col("path")))


# States that reports of a verified load are in.
VERIFIED = {"identity": "G1_INFERENCE_VERIFIED", "weights": "DOWNLOADED_AND_SHA256_VERIFIED", "state": "STRICT_STATE_DICT_LOAD_VERIFIED", "inference": "CPU_REFERENCE_SMOKE_EXECUTED"}


def load_rules(markers: tuple[int, int, int] = (2, 3, 4), device: str = "cpu", attention: str = "sdpa") -> dict[str, Column]:
    """The second gate, over identity, weights, state and inference (JSON): each says that it is verified, and they agree."""
    true = lambda document, path: same(at(document, path), F.lit("true"))
    ids = lambda path: F.from_json(at("inference", path), "array<int>")
    rules = {"identity status": same(at("identity", "status"), F.lit(VERIFIED["identity"]))} | {f"{d} state": same(at(d, "state"), F.lit(VERIFIED[d])) for d in ("weights", "state", "inference")}
    rules |= {p: true("identity", p) for p in ("primary_model.weights_downloaded", "primary_model.weights_verified", "claims.tokenizer_verified", "claims.prompt_format_verified", "claims.inference_verified")}
    rules |= {p: same(at("identity", p), F.lit("false")) for p in ("claims.baseline_reproduced", "claims.improvement_claimed")}
    rules |= {"checksum_match": true("weights", "checksum_match"), "strict_load": true("state", "strict_load")}
    rules |= {p: same(F.regexp_replace(at("state", p), r"\s", ""), F.lit("{}" if p == "shape_mismatches" else "[]")) for p in ("missing_keys", "unexpected_keys", "shape_mismatches")}
    rules |= {"qualified_device": same(at("inference", "qualified_device"), F.lit(device)), "attention_mode": same(at("inference", "attention_mode"), F.lit(attention))}
    rules |= {p: same(at("inference", p), F.lit(str(m))) for p, m in zip(("eos_id", "user_marker_id", "assistant_marker_id"), markers, strict=True)}
    rules |= {"input_ids": same(ids("input_ids")[0], F.lit(markers[0])), "generated_ids": F.size(ids("generated_ids")) > 0}
    weight = at("weights", "actual_sha256")
    return rules | {"revision": same(at("inference", "revision"), at("identity", "primary_model.revision")), "weights of inference": same(at("inference", "weight_sha256"), weight), "weights of state": same(at("state", "weight_sha256"), weight)}


def expected_faults(rows: DataFrame, key: str, expected: DataFrame) -> DataFrame:
    """The third gate's counts and metrics: rows (key, numbers) against expected (key, name, value); a row that isn't there breaks all its names."""
    names = [c for c in rows.columns if c != key]
    long = rows.select(F.col(key).alias("__key"), F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in names])).alias("x")).select("__key", "x.name", F.col("x.value").alias("__value"))
    joined = expected.join(long.withColumnRenamed("name", "__name"), (F.col(key) == F.col("__key")) & (F.col("name") == F.col("__name")), "left")
    return joined.where(~F.col("value").cast("double").eqNullSafe(F.col("__value"))).select(F.col("name").alias("rule"), F.col(key).cast("string").alias("key"))


def round_trip_faults(cases: DataFrame, records: DataFrame) -> DataFrame:
    """The third gate's episode for each case (case_id): a call of the record `gate`, its result, an answer: two turns, one result, no
    repair. records: as episodes take them. A model that gets no result says nothing."""
    call = '{"decision":"CALL_TOOL","answerability":"NOT_APPLICABLE","tool_call":{"tool":"get_record","arguments":{"record_id":"gate"}}}'
    answer = '{"decision":"RESPOND","answerability":"SUPPORTED","answer":"found"}'
    spark, case = cases.sparkSession, cases.select("case_id", *[F.array(F.lit("get_record")).alias(c) for c in ("available", "permitted")])
    said = lambda asked: asked.select("case_id", F.when(F.size("results") == 0, call).when(F.element_at("results", -1).contains('"success":true'), answer).alias("raw_output"))
    done, turns, results = run_episodes(case, said, records, spark.createDataFrame([], STATUS), spark.createDataFrame([], FAULT))
    counts = done.join(turns.groupBy("case_id").agg(F.count("*").alias("n_turns")), "case_id", "left").join(results.groupBy("case_id").agg(F.count("*").alias("n_results"), F.count_if("success").alias("good")), "case_id", "left")
    ok = (F.col("terminal_status") == "completed") & (F.col("n_turns") == 2) & (F.col("n_results") == 1) & (F.col("good") == 1) & (F.col("repairs") == 0)
    return counts.where(~F.coalesce(ok, F.lit(False))).select(F.lit("round trip").alias("rule"), F.col("case_id").alias("key"))
