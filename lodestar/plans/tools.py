"""The tool surface: named functions over the engine's tables that take and give plain JSON."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import date
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.claims import limitations
from lodestar.functions.text import number_key, number_parts
from lodestar.operators import charts, cluster, evaluate, keyword
from lodestar.operators.filters import Query
from lodestar.operators.reconcile import latest

from . import planner
from .session import Notifier, Session, Sessions, Tool, narrative, notify

MOST = 25


class Toolset:
    """Tools over patents(doc_id, doc_key, title, specification, assignee, cpc, effective, country).

    A search keeps its index until patents are indexed anew. Nothing here asks a language model: charts take a callable
    that judges a limitation against a text.
    """

    def __init__(self, patents: DataFrame, sessions: Sessions | None = None, judge: Callable[[str, str], dict] | None = None, notifiers: list[Notifier] | None = None) -> None:
        self._patents, self._index = patents, keyword.build(patents)
        self._sessions, self._judge, self._notifiers = sessions, judge, notifiers or []
        self._charts: dict[tuple[str, str], dict] = {}
        self._steps: dict[str, list] = {}

    # ---- search

    def _key(self, raw: str) -> str | None:
        return self._patents.sparkSession.range(1).select(number_key(number_parts(F.lit(raw)))).first()[0]

    def search_patents(self, keywords: list[str] | None = None, limit: int = MOST, **parameters: Any) -> dict:
        """Ranked patents; keywords that are all numbers are looked up instead."""
        keys = [self._key(k) if any(c.isdigit() for c in k) else None for k in keywords or []]
        if keys and all(keys):
            rows = self._patents.where(F.col("doc_key").isin(*keys)).select("doc_key", "title").limit(MOST).collect()
            return {"results": [{"patent_number": r[0], "title": r[1], "score": 1.0} for r in rows]}
        for name in ("before", "after"):
            if isinstance(parameters.get(name), str):
                parameters[name] = date.fromisoformat(parameters[name])
        query = Query(keywords=tuple(keywords or ()), limit=max(1, min(MOST, limit)), **parameters)
        found = keyword.search(self._patents, query, self._index)
        order = Window.orderBy(F.desc("score"), "doc_id")  # a page of results
        rows = found.withColumn("_n", F.row_number().over(order)).join(self._patents.select("doc_id", "doc_key", "title"), "doc_id").orderBy("_n").collect()
        return {"results": [{"patent_number": r["doc_key"], "title": r["title"], "score": round(r["score"], 4)} for r in rows]}

    def get_patent(self, number: str) -> dict:
        row = self._patents.where(F.col("doc_key") == self._key(number)).orderBy("doc_id").limit(1).first()
        return json.loads(json.dumps(row.asDict(recursive=True), default=str)) if row else {"error": f"no patent {number}"}

    def index_patents(self, rows: DataFrame) -> dict:
        """Adds patents, in place of those of the same key."""
        self._patents = keyword.upsert(self._patents, latest(rows.withColumn("ingest_seq", F.col("doc_id")), "doc_key").select(*self._patents.columns), "doc_key")
        self._index = keyword.build(self._patents)
        return {"indexed": rows.count()}

    # ---- guided searches

    def guided_search_start(self, number: str, kind: str = "invalidity") -> dict:
        target = self._patents.where(F.col("doc_key") == self._key(number)).limit(1)
        plan = [r.asDict(recursive=True) for r in planner.angles(target).orderBy("n").collect()]
        if not plan:
            return {"error": f"no patent {number}"}
        session = Session(kind, self._key(number), json.loads(json.dumps(plan, default=str)))
        return self._kept(session)

    def _kept(self, session: Session) -> dict:
        if self._sessions is not None:
            self._sessions.save(session)
        return {"session": session.id, "state": session.state, "plan": session.plan, "results": session.results}

    def _session(self, id_: str) -> Session:
        if self._sessions is None:
            raise LookupError("no sessions are kept")
        return self._sessions.get(id_)

    def guided_search_feedback(self, session: str, verdicts: dict | None = None, text: str = "") -> dict:
        held = self._session(session)
        if held.state == "awaiting_result_feedback":
            held.result_feedback(verdicts or {}, text)
        else:
            held.plan_feedback({int(k): v for k, v in (verdicts or {}).items()}, text)
        return self._kept(held)

    def guided_search_execute(self, session: str) -> dict:
        held = self._session(session)

        def run(s: Session) -> list[dict]:
            found: dict[str, dict] = {}
            for angle in s.plan:
                before = date.fromisoformat(angle["before"]) if angle.get("before") and s.kind == "invalidity" else None
                rows = self.search_patents(angle["keywords"], required=tuple(angle["required"]), classes=tuple(angle["classes"]), before=before, deny=(s.target, *s.excluded))
                for r in rows["results"]:
                    if r["patent_number"] not in found or found[r["patent_number"]]["score"] < r["score"]:
                        found[r["patent_number"]] = r
            return sorted(found.values(), key=lambda r: (-r["score"], r["patent_number"]))[:MOST]

        held.execute(run)
        return self._kept(held)

    def guided_search_status(self, session: str) -> dict:
        return self._kept(self._session(session))

    def get_search_trace(self, session: str) -> dict:
        return {"trace": narrative(self._steps.get(session, []))}

    def estimate_search_time(self, queries: int = 3, corpus: int = planner.CORPUS, with_model: bool = False, claims: int = 0) -> dict:
        row = self._patents.sparkSession.range(1).select(planner.seconds(F.lit(queries), F.lit(corpus), F.lit(with_model), F.lit(claims)))
        return {"seconds": row.first()[0]}

    # ---- charts

    def summarize_key_limitations(self, claim: str, number: int = 1) -> dict:
        return {"limitations": [{"label": name, "text": text} for name, text, _, _ in limitations(claim, number)]}

    def chart_limitation(self, limitation: str, references: dict[str, str]) -> dict:
        """Findings on a limitation in each reference's text; those made before are kept."""
        if self._judge is None:
            return {"error": "charting needs a judge"}
        for name, text in references.items():
            if (limitation, name) not in self._charts:
                self._charts[limitation, name] = self._judge(limitation, text)
        return {"findings": [{"limitation": limitation, "ref_key": n, **self._charts[limitation, n]} for n in references]}

    def build_claim_chart(self, claim: str, references: dict[str, str], number: int = 1, query: str = "") -> dict:
        rows = []
        for _, text, _, _ in limitations(claim, number):
            found = self.chart_limitation(text, references)
            if "error" in found:
                return found
            rows += [(query, f["limitation"], f["ref_key"], f.get("status", ""), f.get("reasoning", "")) for f in found["findings"]]
        table = self._patents.sparkSession.createDataFrame(rows, "query_key string, limitation string, ref_key string, status string, reasoning string")
        table = table.withColumn("status", charts.status(F.col("status")))
        return {"markdown": charts.markdown(table, query), "coverage": charts.combined_coverage(table).first()["coverage"]}

    # ---- the rest

    def cluster_patents(self, vectors: DataFrame, k: int | None = None) -> dict:
        labels = cluster.kmeans(vectors, k) if k else cluster.choose_k(vectors)[1]
        return {"clusters": {str(r[0]): r[1] for r in labels.groupBy("label").count().collect()}}

    def run_eval(self, queries: DataFrame, references: DataFrame, k: int = 100) -> dict:
        """queries: query_id, text; references: query_id, ref (doc_id)."""
        search = lambda q: keyword.ranked(keyword.scored(self._index, keyword.terms(q, F.col("text"))), k).select("query_id", "rank", F.col("doc_id").alias("ref"))
        _, means, _ = evaluate.run(search, queries, references, k)
        return {r["metric"]: r["value"] for r in means.collect()}

    def notify(self, subject: str, body: str) -> dict:
        return {"sent": notify(self._notifiers, subject, body)}

    NAMES = ("search_patents", "get_patent", "guided_search_start", "guided_search_feedback", "guided_search_execute", "guided_search_status", "get_search_trace", "estimate_search_time", "chart_limitation", "build_claim_chart", "summarize_key_limitations", "notify", "index_patents", "cluster_patents", "run_eval")

    def tools(self) -> list[Tool]:
        return [Tool(n, (getattr(self, n).__doc__ or n).strip(), {"type": "object"}, lambda a, n=n: getattr(self, n)(**a)) for n in self.NAMES]

    def dispatch(self, name: str, arguments: dict | None = None) -> dict:
        """What a tool gives; an unknown tool, wrong arguments and failures give an error."""
        if name not in self.NAMES:
            return {"error": f"unknown tool {name!r}; there are {list(self.NAMES)}"}
        try:
            return json.loads(json.dumps(getattr(self, name)(**(arguments or {})), default=str))
        except Exception as error:  # noqa: BLE001  the caller is told
            return {"error": f"{name}: {error}"}
