"""The engine as one object: what the service answers, as DataFrames, and the life of crawl tasks on the driver."""

from __future__ import annotations

import dataclasses
import datetime as dt
import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.url import should_skip, with_keys
from corpusloom.functions.view import metric_cards
from corpusloom.operators.crawl import crawl, crawl_graph, fetchable
from corpusloom.operators.graph import nodes, simple_edges, truncate
from corpusloom.operators.index import index_stats, number_by_first_use, remove, search, stored_index, term_freq, top_keywords
from corpusloom.operators.schedule import throughput
from corpusloom.sources.tables import stored

#: Which states a task may go to.
MOVES = {
    "pending": {"running", "failed", "stopped"},
    "running": {"paused", "stopped", "completed", "failed"},
    "paused": {"running", "stopped"},
    "stopped": set(),
    "completed": set(),
    "failed": set(),
}


class TaskError(ValueError):
    """A task that is not there, or a change its state does not allow."""

    #: Status of an answer for each code.
    STATUS = {"VALIDATION_ERROR": 400, "NOT_FOUND": 404, "TASK_STATE": 409, "CONFLICT": 409}

    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code

    def answer(self) -> tuple[int, dict]:
        """(status, envelope) of an answer."""
        return self.STATUS.get(self.code, 500), {"error": {"code": self.code, "message": str(self)}}


def clock(at: dt.datetime | None) -> str:
    """Clock time eight hours east of UTC; empty for none."""
    return (at.astimezone(dt.UTC) + dt.timedelta(hours=8)).strftime("%Y-%m-%d %H:%M:%S") if at else ""


@dataclasses.dataclass(frozen=True)
class Strategy:
    """What to crawl and how; limits are put in range, missing ones get their defaults."""

    seeds: tuple[str, ...] = ()
    workers: int = 8
    global_rps: float = 0.0
    host_rps: float = 0.0
    max_depth: int = 4
    max_pages: int = 200
    user_agent: str = "corpusloom/1.0"

    @classmethod
    def from_json(cls, body: str, fixture: str = "", mode: str = "mock") -> Strategy:
        """A strategy from the JSON of a request; unknown fields are ignored, an empty body has none. The fixture's seed takes the
        place of others if `use_fixture` is set, or of none in mock mode."""
        try:
            said = json.loads(body) if body.strip() else {}
            seeds = tuple(said.get("seeds") or ())
            if said.get("use_fixture") or not seeds and mode == "mock":
                seeds = (fixture,)
            kinds = {"workers": int, "global_rps": float, "host_rps": float, "max_depth": int, "max_pages": int, "user_agent": str}
            given = {k: said[k] for k in kinds if said.get(k) is not None}
            if any(isinstance(v, bool) or not isinstance(v, (int, float) if kinds[k] is float else kinds[k]) for k, v in given.items()) or not all(isinstance(x, str) for x in seeds):
                raise TypeError
        except (ValueError, TypeError, AttributeError):
            raise TaskError("VALIDATION_ERROR", "invalid json") from None
        return cls(seeds=seeds, **{"workers": 0, "max_depth": 0, "max_pages": 0, "user_agent": "", **given})

    def checked(self) -> Strategy:
        """Raise for numbers outside 0-64 workers, 0-20 levels and 0-5000 pages."""
        for name, most in (("workers", 64), ("max_depth", 20), ("max_pages", 5000)):
            if not 0 <= getattr(self, name) <= most:
                raise TaskError("VALIDATION_ERROR", f"{name} must be between 0 and {most}")
        return self

    def clamped(self) -> Strategy:
        put = lambda x, default, most: min(x if x > 0 else default, most)
        return dataclasses.replace(
            self,
            workers=put(self.workers, 8, 64),
            max_depth=put(self.max_depth, 4, 20),
            max_pages=put(self.max_pages, 200, 5000),
            global_rps=max(self.global_rps, 0.0),
            host_rps=max(self.host_rps, 0.0),
            user_agent=self.user_agent.strip() or "corpusloom/1.0",
        )


@dataclasses.dataclass
class Task:
    id: str
    strategy: Strategy
    status: str = "pending"
    crawled: int = 0
    queue: int = 0
    error: str = ""
    created_at: dt.datetime = dataclasses.field(default_factory=lambda: dt.datetime.now(dt.UTC))
    started_at: dt.datetime | None = None
    finished_at: dt.datetime | None = None

    def move(self, to: str) -> None:
        if to not in MOVES[self.status]:
            raise TaskError("TASK_STATE", f"a task that is {self.status} cannot become {to}")
        self.status = to
        now = dt.datetime.now(dt.UTC)
        if to == "running":
            self.started_at = self.started_at or now
        elif not MOVES[to]:
            self.finished_at = now

    def view(self) -> dict:
        """What an answer says of the task; times as clock times."""
        return {
            "id": self.id,
            "status": self.status,
            "strategy": dataclasses.asdict(self.strategy),
            "crawled": self.crawled,
            "queue_length": self.queue,
            "error": self.error,
            "created_at": clock(self.created_at),
            "started_at": clock(self.started_at),
            "finished_at": clock(self.finished_at),
        }


class Engine:
    """Documents (doc_id, url, title, body), their index, links (src, dst) and tasks."""

    def __init__(self, spark: SparkSession, docs: DataFrame, links: DataFrame | None = None, mode: str = "mock", fixture: str = "") -> None:
        self.spark, self.docs = spark, docs
        self.links = links if links is not None else spark.createDataFrame([], "src string, dst string")
        self.mode, self.fixture = mode, fixture
        self.tasks: dict[str, Task] = {}
        self._index: DataFrame | None = None

    @property
    def index(self) -> DataFrame:
        """Postings, built once and stored by term, so that a search reads few row groups."""
        if self._index is None:
            self._index = stored_index(self.docs)
        return self._index

    def health(self) -> DataFrame:
        """One row (status, time, mode)."""
        return self.spark.createDataFrame([("ok", clock(dt.datetime.now(dt.UTC)), self.mode)], "status string, time string, mode string")

    def search(self, query: str, limit: int = 20, mark: bool = True) -> DataFrame:
        if not query.strip():
            raise TaskError("VALIDATION_ERROR", "q is required")
        return search(self.docs, self.index, query.strip(), limit, mark)

    def found(self, query: str, limit: int = 20, mark: bool = True) -> dict:
        """The answer to a search: its query, the number of hits after the limit, and the hits."""
        hits = [r.asDict() for r in self.search(query, limit, mark).collect()]
        return {"query": query.strip(), "total": len(hits), "hits": hits}

    def keywords(self, limit: int = 30) -> DataFrame:
        return top_keywords(term_freq(self.index), limit)

    def waiting(self) -> DataFrame:
        """(url) of addresses that are linked to but were not crawled."""
        ends = simple_edges(self.links).select(F.col("dst").alias("url")).distinct()
        return ends.join(self.docs.select("url").where(F.col("url").isNotNull()).distinct(), "url", "left_anti")

    def stats(self, events: DataFrame | None = None, ts: str = "fetched_at") -> DataFrame:
        """One row of eight figures: pages crawled by the tasks, addresses waiting, documents and terms of the index, the rate of
        the last second of `events`, workers active and configured, the mode, and the time."""
        rate = 0.0
        if events is not None:
            last = throughput(events, ts).orderBy(F.desc("t")).first()
            rate = last["rps"] if last else 0.0
        live = [t for t in self.tasks.values() if t.status in ("running", "paused")]
        active = sum(t.strategy.workers for t in live if t.status == "running")
        row = index_stats(self.docs, self.index).first()
        known = (sum(t.crawled for t in self.tasks.values()), self.waiting().count(), row["docs"], row["terms"], float(rate), active, sum(t.strategy.workers for t in live))
        return self.spark.createDataFrame(
            [(*known, self.mode, clock(dt.datetime.now(dt.UTC)))],
            "pages_crawled bigint, queue_length bigint, index_docs bigint, index_terms bigint, current_rps double, active int, configured int, crawl_mode string, updated_at string",
        )

    def cards(self, events: DataFrame | None = None) -> DataFrame:
        return metric_cards(self.stats(events))

    def graph(self, limit: int = 400) -> tuple[DataFrame, DataFrame]:
        return truncate(nodes(self.docs.select("url", "title"), self.links), self.links, limit)

    def timeseries(self, events: DataFrame, ts: str = "fetched_at") -> DataFrame:
        return throughput(events, ts)

    def remove(self, ids: Iterable[int]) -> None:
        gone = self.spark.createDataFrame([(int(i),) for i in ids], "doc_id bigint")
        left = stored(remove(self.index, gone), "index")
        self.docs, self._index = self.docs.join(gone, "doc_id", "left_anti"), left

    def clear(self) -> None:
        """An empty index and an empty graph, ids start at 1 again; tasks and their counters stay."""
        self.docs, self.links, self._index = self.docs.limit(0), self.links.limit(0), None

    def create(self, strategy: Strategy) -> Task:
        """A task, unless one is running or no seed is left."""
        strategy = strategy.checked()
        if any(t.status in ("running", "paused") for t in self.tasks.values()):
            raise TaskError("CONFLICT", "another task is active already")
        task = Task(uuid.uuid4().hex[:16], strategy.clamped())
        self.tasks[task.id] = task
        return task

    def request(self, body: str) -> tuple[int, dict]:
        """(201, view) of a task created from the JSON of a request, or (status, error)."""
        try:
            return 201, self.create(Strategy.from_json(body, self.fixture, self.mode)).view()
        except TaskError as err:
            return err.answer()

    def get(self, task_id: str) -> Task:
        if task_id not in self.tasks:
            raise TaskError("NOT_FOUND", "no such task")
        return self.tasks[task_id]

    def list(self) -> list[Task]:
        return sorted(self.tasks.values(), key=lambda t: t.created_at, reverse=True)

    def pause(self, task_id: str) -> Task:
        self.get(task_id).move("paused")
        return self.get(task_id)

    def resume(self, task_id: str) -> Task:
        if self.get(task_id).status != "paused":
            raise TaskError("TASK_STATE", f"a task that is {self.get(task_id).status} cannot be resumed")
        self.get(task_id).move("running")
        return self.get(task_id)

    def stop(self, task_id: str) -> Task:
        self.get(task_id).move("stopped")
        return self.get(task_id)

    def run(self, task_id: str, pages: DataFrame, links: DataFrame, rules: DataFrame | None = None, base: str | None = None) -> DataFrame:
        """Crawl from the task's seeds over known pages (url, title, body, and perhaps status and content_type); their documents
        and links join the engine's under their crawl keys."""
        task = self.get(task_id)
        task.move("running")
        seeds = with_keys(self.spark.createDataFrame([(s,) for s in task.strategy.seeds], "url string").where(~should_skip(F.col("url"))), "url")
        if not seeds.count():
            task.error = "no seeds"
            task.move("failed")
            return seeds
        pages = stored(with_keys(fetchable(pages), "url").dropDuplicates(["url"]), "pages")
        links = stored(with_keys(links.select("src", "dst"), "src", "dst"), "keyed-links")
        done = crawl(seeds, links, pages, rules, task.strategy.max_depth, task.strategy.max_pages, self.docs.select("url"), base, keyed=True)
        task.crawled = done.count()
        last = self.docs.agg(F.coalesce(F.max("doc_id"), F.lit(0))).first()[0]
        ids = number_by_first_use(done, "url", "depth").select("url", (F.col("id") + last).alias("doc_id"))
        new = ids.join(pages, "url").select("doc_id", "url", "title", "body")
        self.docs = stored(self.docs.select("doc_id", "url", "title", "body").unionByName(new), "docs")
        self.links = stored(self.links.select("src", "dst").unionByName(crawl_graph(done, links, task.strategy.max_depth)).distinct(), "links")
        self._index = None
        task.queue = self.waiting().count() if task.crawled >= task.strategy.max_pages else 0
        task.move("completed")
        return done
