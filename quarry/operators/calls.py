"""Model calls that survive failures: requests with signatures, bounded concurrency, retries, and answers that are kept.

A request is the JSON that a chat or embedding service takes, built in DataFrame functions; its signature is the SHA-256 of that
text. Requests of equal signature are one request. A transport (any picklable object with `send`) carries it out; nothing here opens a
connection unless `Http` is given.

Answers live in a store, a folder that driver and executors share. `answers` holds what earlier runs committed, `journal` what tasks
have been told since: each answer is written there under its signature the moment it comes, so a task that is lost and repeated,
or a run that is stopped and started again, reads it instead of asking a second time. After a run its answers are committed
to `answers` and the journal is emptied. Failed requests come back as rows with an error; they are not kept, so a later run asks again.

Defined results: a null request gets a null answer and no call; repeated requests share an answer; a refusal that a retry cannot mend
(`RETRIED` lists those it can), or the last attempt's failure, ends in the error column and leaves other requests alone; without
requests no call is made. Where speculative execution runs a task twice at once, both may ask.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from typing import Protocol

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The statuses after which a service may be asked again.
RETRIED = (408, 409, 425, 429, 500, 502, 503, 504)

ANSWERS = "signature string, answer string, attempts int"


class Refused(Exception):  # noqa: N818
    """An answer that is no success; status is None where there was no connection."""

    def __init__(self, status: int | None, detail: str = "") -> None:
        super().__init__(f"{status if status is not None else 'no connection'}: {detail}"[:500])
        self.status = status


class Transport(Protocol):
    def send(self, request: str) -> str:
        """The text that the service answers with, or Refused."""


class Http:
    """A service that takes requests by POST; key: read in the task, so that it is in no plan."""

    def __init__(self, url: str, key: Callable[[], str] | None = None, timeout: float = 120.0) -> None:
        self.url, self.key, self.timeout = url, key, timeout

    def send(self, request: str) -> str:
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key()}"} if self.key else {})
        try:
            with urllib.request.urlopen(urllib.request.Request(self.url, request.encode(), head), timeout=self.timeout) as said:
                return said.read().decode()
        except urllib.error.HTTPError as e:
            raise Refused(e.code, e.read().decode(errors="replace")) from e
        except OSError as e:
            raise Refused(None, str(e)) from e


def chat_request(model: Column, system: Column, user: Column, images: Column | None = None, temperature: float = 0.2, as_object: bool = False) -> Column:
    """The request of a chat; images: an array of URLs (see `image_urls`), which follow the text. Null where the user's text is null."""
    said: Column = user
    if images is not None:
        no = F.lit(None)
        text = F.struct(F.lit("text").alias("type"), user.alias("text"), no.cast("struct<url:string>").alias("image_url"))
        shown = F.transform(images, lambda u: F.struct(F.lit("image_url").alias("type"), no.cast("string").alias("text"), F.struct(u.alias("url")).alias("image_url")))
        said = F.concat(F.array(text), shown)
    message = F.array(F.to_json(F.struct(F.lit("system").alias("role"), system.alias("content"))), F.to_json(F.struct(F.lit("user").alias("role"), said.alias("content"))))
    form = F.lit(',"response_format":{"type":"json_object"}' if as_object else "")
    built = F.concat(F.lit('{"model":'), F.to_json(F.array(model)).substr(F.lit(2), F.length(F.to_json(F.array(model))) - 2), F.lit(f',"temperature":{temperature},"messages":['), F.concat_ws(",", message), F.lit("]"), form, F.lit("}"))
    return F.when(user.isNotNull(), built)


def embed_request(model: Column, text: Column) -> Column:
    return F.when(text.isNotNull(), F.to_json(F.struct(model.alias("model"), text.alias("input"))))


def image_urls(spark: SparkSession, root: str, pattern: str = "*.{png,jpg,jpeg,gif,webp}") -> DataFrame:
    """(path, url): the images below root as data URLs."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    kind = F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1))
    return rows.select("path", F.concat(F.lit("data:image/"), F.when(kind == "jpg", "jpeg").otherwise(kind), F.lit(";base64,"), F.base64("content")).alias("url"))


def content_of(answer: str) -> str:
    """The text inside a chat service's answer."""
    return json.loads(answer)["choices"][0]["message"]["content"]


def object_in(text: str) -> str:
    """The JSON object in a text, which may stand in a code fence or between words; ValueError without one."""
    at = text.find("{")
    while at >= 0:
        try:
            found, _ = json.JSONDecoder().raw_decode(text, at)
        except ValueError:
            at = text.find("{", at + 1)
        else:
            return json.dumps(found, ensure_ascii=False)
    raise ValueError("no JSON object in the answer")


def object_answer(answer: str) -> str:
    return object_in(content_of(answer))


class Journal:
    """One small file per answer, by signature, in a folder of any file system that pyarrow opens."""

    def __init__(self, root: str) -> None:
        self.root = root

    def _at(self, signature: str) -> tuple[fs.FileSystem, str]:
        system, path = fs.FileSystem.from_uri(self.root)
        return system, f"{path}/{signature[:2]}/{signature}"

    def get(self, signature: str) -> tuple[str, int] | None:
        system, path = self._at(signature)
        if system.get_file_info(path).type != fs.FileType.File:
            return None
        with system.open_input_stream(path) as f:
            answer, attempts = json.loads(f.read())
        return answer, attempts

    def put(self, signature: str, answer: str, attempts: int) -> None:
        system, path = self._at(signature)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        part = f"{path}.part-{uuid.uuid4().hex}"
        with system.open_output_stream(part) as f:
            f.write(json.dumps([answer, attempts]).encode())
        system.move(part, path)  # whole or absent


def asked(transport: Transport, request: str, attempts: int, pause: float, reads: Callable[[str], str]) -> tuple[str | None, str | None, int]:
    """(answer, error, attempts made): refusals that may pass and answers that `reads` cannot read are tried again, each time after twice the pause."""
    for n in range(1, attempts + 1):
        try:
            return reads(transport.send(request)), None, n
        except Refused as e:
            error = str(e)
            if e.status is not None and e.status not in RETRIED:
                return None, error, n
        except (ValueError, KeyError, IndexError, TypeError) as e:
            error = f"unreadable answer: {e}"[:500]
        if n < attempts:
            time.sleep(pause * 2 ** (n - 1))
    return None, error, attempts


def _pending(transport: Transport, journal: Journal, at_once: int, attempts: int, pause: float, reads: Callable[[str], str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def one(signature: str, request: str) -> tuple[str, str | None, str | None, int]:
        if known := journal.get(signature):
            return signature, known[0], None, known[1]
        answer, error, n = asked(transport, request, attempts, pause, reads)
        if answer is not None:
            journal.put(signature, answer, n)
        return signature, answer, error, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(done: set[Future]) -> pa.RecordBatch:
            rows = [f.result() for f in done]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.string(), pa.int32()), strict=True)], names=["signature", "answer", "error", "attempts"])

        with ThreadPoolExecutor(at_once) as pool:
            open_: set[Future] = set()
            for b in batches:
                for signature, request in zip(b.column(0), b.column(1), strict=True):
                    if len(open_) >= 2 * at_once:  # as many wait as are being asked, however many rows there are
                        done, open_ = wait(open_, return_when=FIRST_COMPLETED)
                        yield told(done)
                    open_.add(pool.submit(one, signature.as_py(), request.as_py()))
            if open_:
                yield told(wait(open_).done)

    return run


def committed(spark: SparkSession, store: str) -> DataFrame:
    """(signature, answer, attempts) that earlier runs committed to a store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/answers")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], ANSWERS)
    return spark.read.schema(ANSWERS).parquet(f"{store}/answers")


def answered(rows: DataFrame, request: str, store: str, transport: Transport, tasks: int | None = None, at_once: int = 8, attempts: int = 3, pause: float = 1.0, reads: Callable[[str], str] = content_of) -> DataFrame:
    """rows with signature, answer, error and attempts. Requests that the store does not know are made by now, each once.

    tasks: how many tasks ask, each up to `at_once` requests at a time, so the service sees tasks x at_once of them at most.
    """
    spark = rows.sparkSession
    signed = rows.withColumn("signature", F.sha2(F.col(request), 256))
    known = committed(spark, store)
    wanted = signed.filter(F.col("signature").isNotNull()).select("signature", F.col(request).alias("request")).dropDuplicates(["signature"]).join(known.select("signature"), "signature", "left_anti")
    dealt = wanted.repartition(tasks or spark.sparkContext.defaultParallelism, "signature")
    run = _pending(transport, Journal(f"{store}/journal"), at_once, attempts, pause, reads)
    folder = f"{store}/asked/{time.time_ns()}"
    dealt.mapInArrow(run, "signature string, answer string, error string, attempts int").write.parquet(folder)
    fresh = spark.read.schema("signature string, answer string, error string, attempts int").parquet(folder)
    fresh.filter("error is null").select("signature", "answer", "attempts").write.mode("append").parquet(f"{store}/answers")
    journal = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/journal")
    journal.getFileSystem(spark._jsc.hadoopConfiguration()).delete(journal, True)  # all of it is committed now
    found = committed(spark, store).withColumn("error", F.lit(None).cast("string")).unionByName(fresh.filter("error is not null"))
    return signed.join(found, "signature", "left")


def vectors(answer: Column) -> Column:
    """The vector of an embedding service's answer, kept as text by `answered(..., reads=embedding_of)`."""
    return F.from_json(answer, "array<double>")


def embedding_of(answer: str) -> str:
    """The vector inside an embedding service's answer; ValueError if it is empty or holds what is no number."""
    vector = json.loads(answer)["data"][0]["embedding"]
    if not vector or not all(isinstance(x, (int, float)) for x in vector):
        raise ValueError("an empty or invalid vector")
    return json.dumps(vector)


class Stub:
    """A transport without a service: it answers by the request's last text, refuses some requests once, and some for good, as the hash of the text says."""

    def __init__(self) -> None:
        self.seen: set[str] = set()

    def send(self, request: str) -> str:
        said = json.loads(request)
        content = said["messages"][-1]["content"]
        text = content if isinstance(content, str) else content[0]["text"]
        digest = hashlib.sha256(text.encode()).hexdigest()
        if digest[0] == "0":
            raise Refused(400, "bad request")
        if digest[0] in "1234" and request not in self.seen:
            self.seen.add(request)
            raise Refused(503, "busy")
        return json.dumps({"choices": [{"message": {"role": "assistant", "content": f"offline:{digest[:12]}"}}]})
