"""Schemas of the records at rest, as DDL.  Scans always name one; none is inferred."""

from __future__ import annotations

EXAMPLE = "id STRING, targetLanguage STRING, instruction STRING, code STRING, tags ARRAY<STRING>, metadata STRUCT<author: STRING, created: STRING, source: STRING, notes: STRING>, judgeScore DOUBLE, topicId STRING"
HELD_OUT_TASK = "id STRING, targetLanguage STRING, topicId STRING, instruction STRING, tags ARRAY<STRING>, acceptanceCriteria STRUCT<mustParse: BOOLEAN, mustContain: ARRAY<STRING>, mustNotContain: ARRAY<STRING>>"
KEYWORDS = "language STRING, topic_ord INT, topic_id STRING, kw_ord INT, keyword STRING"
TOPICS = "id STRING, language STRING, difficulty STRING, tags ARRAY<STRING>, pattern STRING"
RATES = "STRUCT<taskCount: BIGINT, passAt1: DOUBLE, passAt5: DOUBLE, syntaxValidityRate: DOUBLE>"
BENCHMARK = (
    "runId STRING, experimentId STRING, compressionMethod STRING, evidenceLevel STRING, datasetVersion STRING, heldOutTestSetVersion STRING, studentModel STRING, passAt1 DOUBLE, passAt5 DOUBLE, syntaxValidityRate DOUBLE, "
    f"peakVramGb DOUBLE, durationSeconds DOUBLE, trainableParamCount BIGINT, loraRank INT, byLanguage MAP<STRING, {RATES}>, paramMatch STRUCT<matched: BOOLEAN, deltaPercent: DOUBLE, anchorParamCount: BIGINT, trainableParamCount: BIGINT, footnoteRequired: BOOLEAN>, "
    "tagBuckets ARRAY<STRUCT<tag: STRING, taskCount: BIGINT, passAt1: DOUBLE, passAt5: DOUBLE>>, tasks ARRAY<STRUCT<taskId: STRING, targetLanguage: STRING, tags: ARRAY<STRING>, passAt1: BOOLEAN, passAt5: BOOLEAN>>"
)
MANIFEST = "datasetVersion STRING, draftId STRING, state STRING, targetLanguage STRING, targetLanguages ARRAY<STRING>, exampleCount BIGINT, syntaxPassRate DOUBLE, publishedAt STRING, publishedBy STRING, br005Satisfied BOOLEAN, countsByLanguage MAP<STRING, BIGINT>, sourceVersions ARRAY<STRING>"
CHECKPOINT = "runId STRING, datasetVersion STRING, studentModel STRING, compressionMethod STRING, loraRank INT, profile STRING, trainExampleCount BIGINT, epochs INT, steps BIGINT, seed BIGINT, finalLoss DOUBLE, trainableParamCount BIGINT, peakVramGb DOUBLE, durationSeconds DOUBLE, backend STRING, targetLanguage STRING, dataSchedule STRING, trainingState STRING, dryRun BOOLEAN, evidenceLevel STRING, heldOutTestSetVersion STRING"
EVENT = "event STRING, timestamp STRING, runId STRING, payload STRING"
