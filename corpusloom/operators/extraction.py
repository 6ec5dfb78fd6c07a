"""Occurrences and events from texts: one Arrow pass for the matching, joins for the rest."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from corpusloom.functions.matching import EntityMatcher, Lexicon, RelationMatcher, Tagger, is_modal, is_negated, sentences, slugified
from corpusloom.functions.measures import confidence
from corpusloom.operators.edges import abstract_events, sentence_events

_TEXT, _NUMBER, _FLAG = pa.string(), pa.int32(), pa.bool_()
MATCH = pa.schema(
    [("doc", pa.int64()), ("kind", _TEXT), ("sentence", _NUMBER)]
    + [(c, _TEXT) for c in ("item", "label", "type")]
    + [("start", _NUMBER), ("end", _NUMBER)]
    + [(c, _TEXT) for c in ("matched", "alias", "target", "target_type", "relation", "cue")]
    + [("cue_distance", _NUMBER), ("cue_between", _FLAG), ("negated", _FLAG), ("modal", _FLAG)]
)


class SentenceReader:
    """Candidates, entities and relations of single sentences, with compiled patterns."""

    def __init__(self, lexicon: Lexicon, reach: int = 180):
        self.lexicon, self.reach = lexicon, reach
        self.tagger = Tagger(lexicon.tags, lexicon.context, lexicon.needs_context, lexicon.window, lexicon.windows)
        self.entities = EntityMatcher(lexicon.entities)
        self.relations = RelationMatcher(lexicon.relations)

    def candidates(self, text: str) -> list[dict]:
        """One entry a label: its first span, all spans, and its tags joined by |."""
        lexicon, found = self.lexicon, {}
        for tag, span in self.tagger.find(text):
            if lexicon.scope is not None and tag not in lexicon.scope or not all(r.keeps(tag, text, span) for r in lexicon.case_rules):
                continue
            label = lexicon.labels.get(tag, tag)
            entry = found.setdefault(label, {"item": f"candidate:{slugified(label)}", "label": label, "span": span, "spans": [], "tags": set()})
            entry["spans"].append(span)
            entry["tags"].add(tag)
        return list(found.values())

    def rows(self, doc: int, number: int, sentence: str) -> Iterator[dict]:
        text = self.lexicon.normaliser(sentence)
        base = {"doc": doc, "sentence": number}
        candidates = self.candidates(text)
        for c in candidates:
            a, b = c["span"]
            yield base | {"kind": "candidate", "item": c["item"], "label": c["label"], "type": "candidate", "start": a, "end": b, "matched": text[a:b], "alias": "|".join(sorted(c["tags"]))}
        taken = [s for c in candidates for s in c["spans"]]
        named = {c["item"] for c in candidates} | {t for c in candidates for t in c["tags"]}
        kept = []
        for entity, alias, (a, b) in self.entities.find(text):
            if entity.exclude_with & named or any(a < y and x < b for x, y in taken):
                continue
            kept.append((entity, (a, b)))
            yield base | {"kind": "entity", "item": entity.id, "label": entity.label, "type": entity.type, "start": a, "end": b, "matched": text[a:b], "alias": alias}
        if not candidates or not kept:
            return
        cues = self.relations.find(text)
        first = {e.id: (e, span) for e, span in reversed(kept)}
        for c in candidates:
            for entity, span in first.values():
                best = self.relations.best(cues, c["span"], span, entity.type, self.reach)
                if best:
                    relation, cue, far, between = best
                    yield base | {
                        "kind": "relation", "item": c["item"], "target": entity.id, "target_type": entity.type, "relation": relation.id, "cue": text[cue[0] : cue[1]],
                        "cue_distance": far, "cue_between": between, "negated": is_negated(text, cue), "modal": is_modal(text, cue),
                    }


def matches(texts: DataFrame, lexicon: Lexicon, reach: int = 180) -> DataFrame:
    """All matches of (doc, text) in one table; column ``kind`` tells candidates, entities and relations apart.

    Null texts have none.  Patterns are compiled once a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = SentenceReader(lexicon, reach)
        for batch in batches:
            texts = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            rows = [r for doc, text in texts for n, (_, _, s) in enumerate(sentences(text)) for r in reader.rows(doc, n, s)]
            yield pa.RecordBatch.from_pylist(rows, MATCH)

    rows = texts.select(F.col("doc").cast("long"), "text").where(F.col("text").isNotNull())
    return rows.mapInArrow(run, from_arrow_schema(MATCH))


def extract(texts: DataFrame, lexicon: Lexicon, reach: int = 180) -> dict[str, DataFrame]:
    """occurrences, cooccurrence_events (same sentence), abstract_cooccurrence_events and relation_events.

    Callers that use more than one of them should write ``matches`` to storage and pass it to ``events``.
    """
    return events(matches(texts, lexicon, reach))


def events(found: DataFrame) -> dict[str, DataFrame]:
    """The four tables from the table of matches."""
    occurrences = found.where("kind in ('candidate', 'entity')").select("doc", "kind", "sentence", "item", "label", "type", "start", "end", "matched", "alias")
    left, right = occurrences.where("kind = 'candidate'"), occurrences.where("kind = 'entity'")
    relations = found.where("kind = 'relation'").select(
        "doc", "sentence", F.col("item").alias("source"), "target", "target_type", "relation", "cue", "cue_distance", "cue_between", "negated", "modal",
        confidence(F.col("cue_distance"), F.col("cue_between")).alias("confidence"),
    )
    return {
        "occurrences": occurrences,
        "cooccurrence_events": sentence_events(left, right),
        "abstract_cooccurrence_events": abstract_events(left, right),
        "relation_events": relations,
    }
