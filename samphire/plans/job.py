"""A job over an image folder: scan, normalize, dedupe, metrics, recommendations, with progress and cancellation."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samphire.checkpoints import cut_lineage
from samphire.config import DuplicateOptions, MetricsOptions, NormalizationRules
from samphire.functions.images import fingerprints
from samphire.operators import duplicates, normalize, recommend
from samphire.plans.report import metrics_report
from samphire.sources import rules as rule_files
from samphire.sources import scan, sinks

#: Names and percent of the stages; duplicates come before the metrics, which read their groups.
STAGES = (
    ("validate", 5, "checking the request"),
    ("scan", 20, "reading images and captions"),
    ("normalize", 45, "normalizing tags"),
    ("dedupe", 60, "looking for copies"),
    ("metrics", 80, "measuring tags"),
    ("recommend", 95, "applying rules"),
    ("finalize", 100, "results are written"),
)
QUEUED, RUNNING, COMPLETED, FAILED, CANCELED = "Queued", "Running", "Completed", "Failed", "Canceled"


@dataclass(frozen=True)
class JobRequest:
    input_dir: str
    output_dir: str
    rules_path: str | None = None
    enable_duplicate_detection: bool = True
    enable_tag_metrics: bool = True
    enable_recommendations: bool = True


@dataclass
class JobStatus:
    job_id: str = field(default_factory=lambda: str(uuid.uuid4()))
    state: str = QUEUED
    percent: int = 0
    stage: str = ""
    message: str = ""
    created_at: datetime = field(default_factory=lambda: datetime.now(timezone.utc))
    updated_at: datetime = field(default_factory=lambda: datetime.now(timezone.utc))
    finished_at: datetime | None = None
    error: str | None = None
    outputs: dict[str, Any] = field(default_factory=dict)
    log: list[tuple[datetime, str, str]] = field(default_factory=list)

    @property
    def is_cancelable(self) -> bool:
        return self.state in (QUEUED, RUNNING)


class JobCanceled(Exception):
    pass


class JobRunner:
    """Runs one request at a time in the calling thread; ``cancel`` may come from another one."""

    def __init__(self, spark: SparkSession, progress: Callable[[JobStatus], None] | None = None, normalization: NormalizationRules = NormalizationRules(), metrics: MetricsOptions = MetricsOptions(), duplicate_options: DuplicateOptions = DuplicateOptions()):
        self.spark, self.progress = spark, progress or (lambda _: None)
        self.normalization, self.metrics, self.duplicate_options = normalization, metrics, duplicate_options
        self.status, self._stop = JobStatus(), threading.Event()

    def cancel(self) -> bool:
        """Stop before the next stage and interrupt Spark's running work; False if the job is over."""
        if not self.status.is_cancelable:
            return False
        self._stop.set()
        self.spark.sparkContext.cancelJobGroup(self.status.job_id)
        return True

    def _enter(self, stage: str) -> None:
        if self._stop.is_set():
            raise JobCanceled
        percent, message = next((p, m) for s, p, m in STAGES if s == stage)
        self.status.percent, self.status.stage, self.status.message = min(100, max(0, percent)), stage, message
        self.status.updated_at = datetime.now(timezone.utc)
        self.status.log.append((self.status.updated_at, "Information", message))
        self.progress(self.status)

    def run(self, request: JobRequest) -> JobStatus:
        status = self.status
        status.state = RUNNING
        self.spark.sparkContext.setJobGroup(status.job_id, "dataset analysis", interruptOnCancel=True)
        try:
            self._run(request)
            status.state = COMPLETED
        except Exception as error:
            status.state = CANCELED if self._stop.is_set() else FAILED
            status.error = None if self._stop.is_set() else type(error).__name__  # texts of errors may hold paths and captions
            if not isinstance(error, JobCanceled) and status.state == FAILED:
                raise
        finally:
            status.updated_at = status.finished_at = datetime.now(timezone.utc)
            status.log.append((status.finished_at, "Error" if status.state == FAILED else "Information", f"{status.state} {status.error or ''}".rstrip()))
            if request.output_dir and request.output_dir.strip():
                sinks.write_log(status.log, str(Path(request.output_dir) / "job.log"))
            self.progress(status)
        return status

    def _run(self, request: JobRequest) -> None:
        self._enter("validate")
        out = Path(request.output_dir)
        made: dict[str, str] = {}
        rules = []
        if request.rules_path:
            text = Path(request.rules_path).read_text(encoding="utf-8-sig")
            rules = rule_files.recommendation_rules_yaml(text) if request.rules_path.endswith((".yaml", ".yml")) else rule_files.recommendation_rules_json(text)
        self._enter("scan")
        records = cut_lineage(scan.image_records(self.spark, request.input_dir))
        made["dataset_jsonl"], made["summary_index"] = str(out / "dataset.jsonl"), str(out / "summary.json")
        sinks.write_json_lines(records, made["dataset_jsonl"], ["relative_image_path"])
        sinks.write_json(scan.summarize(records).first().asDict() | {"dataset_directory": request.input_dir, "jsonl_path": made["dataset_jsonl"], "summary_path": made["summary_index"]}, made["summary_index"])
        self._enter("normalize")
        tagged = records.select(F.col("relative_image_path").alias("sample_id"), normalize.split_caption(F.coalesce("caption_sources.booru_tags", "caption_sources.short_caption")).alias("tags"))
        samples = cut_lineage(normalize.normalize(tagged, self.normalization).select("sample_id", F.col("normalized_tags").alias("tags")))
        self._enter("dedupe")
        groups = self._duplicates(request, records, out, made) if request.enable_duplicate_detection else None
        self._enter("metrics")
        report = cut_lineage(metrics_report(samples, self.metrics, groups)) if request.enable_tag_metrics else None
        if report is not None:
            made["metrics_json"], made["metrics_markdown"] = str(out / "metrics.json"), str(out / "metrics.md")
            sinks.write_report(report.first(), made["metrics_json"], made["metrics_markdown"])
        self._enter("recommend")
        if report is not None and request.enable_recommendations:
            made["recommendations_json"] = str(out / "recommendations.json")
            matches = recommend.evaluate(recommend.report_signals(report), recommend.rules_frame(self.spark, rules)).collect()  # one row a rule
            sinks.write_json({"matches": matches}, made["recommendations_json"])
        self._enter("finalize")
        self.status.outputs = {"duplicate_detection_enabled": request.enable_duplicate_detection, "tag_metrics_enabled": request.enable_tag_metrics, "recommendations_enabled": request.enable_recommendations, "artifacts": made}

    def _duplicates(self, request: JobRequest, records: DataFrame, out: Path, made: dict[str, str]) -> DataFrame:
        """Writes the duplicate groups; gives (sample_id, group_key) of all samples."""
        root = scan._folder(self.spark, request.input_dir)
        glob = "*.{" + ",".join(scan._any_case(e) for e in scan.IMAGE_EXTENSIONS) + "}"
        images = self.spark.read.format("image").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("dropInvalid", "true").load(request.input_dir)
        prints = cut_lineage(fingerprints(scan.binary_files(self.spark, request.input_dir, scan.IMAGE_EXTENSIONS), images))
        options = self.duplicate_options
        exact, near = cut_lineage(duplicates.exact_groups(prints)), cut_lineage(duplicates.near_groups(prints, options))
        made["duplicates_json"] = str(out / "duplicates")
        artifacts = [("exact_groups", exact, duplicates.group_order()), ("near_groups", near, duplicates.group_order())]
        if options.list_all_pairs:
            artifacts.append(("near_findings", duplicates.near_findings(prints, options), duplicates.finding_order()))
        else:
            artifacts += [("near_findings", duplicates.near_links(prints, options), duplicates.finding_order()), ("near_members", duplicates.near_members(prints), ["class_path", "path"])]
        for name, frame, order in artifacts:
            sinks.write_json_lines(frame, f"{made['duplicates_json']}/{name}", order)
        keyed = near.select(F.explode("paths").alias("path"), "group_id").unionByName(exact.select(F.explode("paths").alias("path"), "group_id"))
        of = keyed.groupBy("path").agg(F.max("group_id").alias("group_key"))  # a near group before an exact one
        relative = F.substring("path", len(root) + 2, 1 << 30)
        return records.select(F.col("relative_image_path").alias("sample_id")).join(of.select(relative.alias("sample_id"), "group_key"), "sample_id", "left")
