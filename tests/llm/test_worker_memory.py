"""Python workers hand memory back after each partition: idle ones count beside the JVM of their executor."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

from millrace.llm import decontaminate, language_id, minhash, sentencepiece_codec
from millrace.llm.queries import tokenizer_path

HELD = """
import re
import pyarrow as pa
from millrace.llm.common import tidy

def held():
    return sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def run(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_pylist())], ["text"])

def left(run):
    start = held()
    for _ in run(pa.RecordBatch.from_arrays([pa.array(["word " * 400] * 1000)], ["text"]) for _ in range(8)):
        pass
    return held() - start

first = left(run)
left(tidy(run))
second = left(tidy(run))
print(first, second, held())
"""


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_memory_goes_back():
    done = subprocess.run([sys.executable, "-c", HELD], cwd=Path(__file__).parents[2], capture_output=True, text=True, check=True)
    plain, tidied, _ = map(float, done.stdout.split())
    assert tidied < max(4, plain / 2), done.stdout


def test_stages_of_the_pipeline_are_tidy(spark, monkeypatch):
    seen = set()
    for module in (language_id, minhash, decontaminate, sentencepiece_codec):

        def noted(run, name=module.__name__, kept=module.tidy):
            seen.add(name)
            return kept(run)

        monkeypatch.setattr(module, "tidy", noted)
    docs = spark.createDataFrame([(1, "some words of a text", "en"), (2, "other words of a text", "en")], "doc_id long, text string, lang string")
    language_id.identify_languages(docs)
    minhash.near_duplicates(docs)
    decontaminate.find_leaks(docs, spark.createDataFrame([("a", "some words of a text that is an item of eight")], "item_id string, text string"))
    sentencepiece_codec.encode_documents(docs, tokenizer_path("piece_bpe_32k.model"))
    assert len(seen) == 4
