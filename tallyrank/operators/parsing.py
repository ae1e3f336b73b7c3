"""Parsing files into records: requests for several at once, results matched by position, retries and fallbacks."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrank.functions import columns as C
from tallyrank.functions import constants as K

#: Answers after which a call is tried again, the tries, and the first wait in seconds.
RETRIED, TRIES, FIRST_WAIT = (429, 500, 502, 503, 504), 6, 2.0
PER_BATCH = 15
FIELDS = "name string, current_title string, years_experience double, career_history array<struct<title:string,company:string,start_date:string,end_date:string>>, skills_listed array<string>, last_active string, education string, location string, resume_text string"


class CallError(Exception):
    """A call that was answered by an error; ``status`` is the answer's number."""

    def __init__(self, status: int, text: str = ""):
        super().__init__(f"answer {status}: {text[:300]}")
        self.status = status


def retrying(call: Callable, *args, sleep: Callable[[float], None] = time.sleep, jitter: Callable[[], float] = lambda: random.uniform(0.8, 1.2)):
    """What ``call`` gives, tried again after answers of ``RETRIED`` and network errors, each time after twice the wait;
    other errors are raised at once, and the last one where no try is left."""
    last = None
    for attempt in range(TRIES):
        try:
            return call(*args)
        except CallError as e:
            if e.status not in RETRIED:
                raise
            last = e
        except (ConnectionError, TimeoutError) as e:
            last = e
        sleep(FIRST_WAIT * 2**attempt * jitter())
    raise RuntimeError(f"no answer after {TRIES} tries") from last


@lru_cache(maxsize=None)
def cached(make: Callable, key: str):
    """What ``make(key)`` loads, once in each worker."""
    return make(key)


def batch_prompts(texts: DataFrame, size: int = PER_BATCH) -> DataFrame:
    """(batch, n, prompt) of (pos, file, text): the texts of a batch under their heads, in order of ``pos`` (from 0)."""
    head = C.filled(K.RESUME_HEAD, n=(F.col("pos") % size + 1).cast("string"), file=F.col("file"))
    part = F.struct("pos", F.concat(head, F.lit("\n"), F.coalesce("text", F.lit(""))).alias("part"))
    rows = texts.groupBy(F.floor(F.col("pos") / size).alias("batch")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(part)).alias("parts"))  # a batch has ``size`` rows
    return rows.select("batch", "n", F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n").alias("prompt"))


def answer_text(answer: Column) -> Column:
    """The text in a model's answer, without the code fence around it."""
    return C.strip_fences(F.get_json_object(answer, "$.candidates[0].content.parts[0].text"))


def zip_by_position(texts: DataFrame, answers: DataFrame, size: int = PER_BATCH) -> tuple[DataFrame, DataFrame]:
    """(matched, remainder): the texts (pos, file, text) with the record at their place of their batch's array of
    records (batch, records), and the texts that a short array leaves over. Records beyond a batch's texts are dropped."""
    rows = texts.withColumn("batch", F.floor(F.col("pos") / size)).withColumn("place", (F.col("pos") % size).cast("int"))
    found = answers.select("batch", F.posexplode("records").alias("place", "record"))
    return rows.join(found, ["batch", "place"]).drop("place"), rows.join(found, ["batch", "place"], "left_anti").drop("place")


def parse_files(files: DataFrame, parser, size: int = PER_BATCH) -> DataFrame:
    """Records of (source_file, text, content): batches of texts, then one by one, then by the page itself.

    ``parser`` has parse(texts) -> list of records, and may have parse_pages(content) -> record. A batch that fails, or
    gives fewer records than texts, leaves its files to be parsed alone; what fails alone, or has no text, is read from its
    pages; what fails there too comes back with an error. The record's fields, source_file, error and how (batch, alone,
    pages, failed) are returned. A failure is told, never dropped. Calls that are answered by an error of ``RETRIED`` are tried again.
    """
    parse = lambda texts: retrying(parser.parse, texts)

    def alone(file: str, text: str | None, content) -> dict:
        error = "no text"
        if text:
            try:
                return {**parse([text])[0], "how": "alone", "error": None}
            except Exception as e:
                error = str(e) or type(e).__name__
        try:
            return {**retrying(parser.parse_pages, bytes(content)), "how": "pages", "error": None}
        except Exception as e:
            return {"how": "failed", "error": f"{error}; {e}"}

    def run(frames: Iterator[pd.DataFrame]):
        for f in frames:
            for at in range(0, len(f), size):
                rows = f.iloc[at : at + size]
                texts = [(i, t) for i, t in enumerate(rows["text"]) if isinstance(t, str) and t.strip()]
                out: dict[int, dict] = {}
                if texts:
                    try:
                        for (i, _), record in zip(texts, parse([t for _, t in texts]), strict=False):
                            out[i] = {**record, "how": "batch", "error": None}
                    except Exception:  # the batch's files are parsed one by one
                        out = {}
                for i, (file, text, content) in enumerate(zip(rows["source_file"], rows["text"], rows["content"], strict=True)):
                    if i not in out:
                        out[i] = alone(file, text if isinstance(text, str) and text.strip() else None, content)
                yield pd.DataFrame({
                    "source_file": list(rows["source_file"]), "how": [out[i]["how"] for i in range(len(rows))], "error": [out[i]["error"] for i in range(len(rows))],
                    "record": [json.dumps({**{k: v for k, v in out[i].items() if k not in ("how", "error")}, **({} if out[i].get("resume_text") else {"resume_text": t if isinstance(t, str) else None})}) for i, t in enumerate(rows["text"])],
                })

    told = files.select("source_file", "text", "content").mapInPandas(run, "source_file string, how string, error string, record string")
    return told.select("source_file", F.from_json("record", FIELDS).alias("r"), "error", "how").select("source_file", "r.*", "error", "how")


class LineParser:
    """The offline parser: the first line is the name, the second the title, a line that begins with Skills: the skills."""

    def parse(self, texts: list[str]) -> list[dict]:
        out = []
        for text in texts:
            lines = [x.strip() for x in text.split("\n") if x.strip()]
            skills = next((x.split(":", 1)[1] for x in lines if x.lower().startswith("skills:")), "")
            out.append({"name": lines[0] if lines else None, "current_title": lines[1] if len(lines) > 1 else None, "skills_listed": [s.strip() for s in skills.split(",") if s.strip()], "resume_text": text})
        return out
