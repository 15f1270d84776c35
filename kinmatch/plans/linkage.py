"""End-to-end plans: index and retrieve, fit the stack, score, decide, write."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.functions.romanise import romanised
from kinmatch.operators import candidates, corpus, decide, features, index, metrics, model, splits
from kinmatch.sources import bindings, tables, working


@dataclass(frozen=True)
class Linkage:
    """One configuration of the whole chain; every method is one lazy plan over all countries."""

    specs: tuple[index.ViewSpec, ...] = index.SPECS
    blocking: index.BlockingConfig = field(default_factory=index.BlockingConfig)
    monotone: bool = True

    def block(self, rec: DataFrame) -> DataFrame:
        """Fused candidates (country, s1, src, cid, scores, ranks, rrf) of records."""
        cfg = self.blocking
        rec = working.cut(romanised(rec), "records")
        views = {s.name: index.retrieve(rec, s, cfg.k, cfg.budget, cfg.min_query_terms, cfg.max_query_terms) for s in self.specs}
        full = bindings.record_tokens(rec)
        keys = candidates.record_keys(corpus.with_core(full, corpus.affixes(full), corpus.affix_bigrams(full)))
        hits = candidates.key_candidates(keys.where("src = 1"), candidates.key_blocks(keys.where("src > 1")), cfg.k_keys)
        return candidates.fuse(views, hits, cfg.max_per_source, cfg.rrf_k)

    def prerank(self, labelled: DataFrame) -> model.Model:
        names = [n for n in list(features.PAIR_FEATURES)[35:46]]
        return model.fit(labelled, names, monotone=self.monotone)

    def prune(self, cand: DataFrame, ranker: model.Model) -> DataFrame:
        """Candidates that the pre-ranker keeps, with its probability as ``pre``."""
        cfg = self.blocking
        scored = ranker.transform(cand, "p")
        return candidates.prune(scored, cfg.prune_min, cfg.prune_max, cfg.prune_eps).withColumnRenamed("p", "pre")

    def featurize(self, rec: DataFrame, cand: DataFrame) -> DataFrame:
        return features.featurize(cand, features.record_view(bindings.record_tokens(romanised(rec))))

    def fit(self, feats: DataFrame, roles: DataFrame, names: list[str] | None = None) -> model.Stack:
        return model.fit_stack(feats, roles, names or list(features.PAIR_FEATURES), self.monotone)

    def decide(self, scored: DataFrame, temperature: float = 0.6) -> DataFrame:
        """The pairs of the best expected F; lists may be long, so counts come from the kernel."""
        warm = scored.withColumn("p", decide.temper(F.col("p"), temperature))
        return decide.apply_decision(warm, decide.decide_expected(warm, arrays=False))

    def evaluate(self, scored: DataFrame, taken: DataFrame, entities: DataFrame) -> DataFrame:
        """The matching report by country; ``scored`` and ``taken`` carry y."""
        return metrics.matching_report(metrics.entity_counts(entities, taken, metrics.truth_sizes(scored)), "country")

    def write(self, entities: DataFrame, taken: DataFrame, path: str) -> dict[str, int]:
        return tables.write_id_lists(tables.id_lists(entities, taken), path, "matched_entity_ids")

    def leave_one_country_out(self, feats: DataFrame, roles: DataFrame) -> list[tuple[str, str, model.Stack]]:
        """(train, score, stack) for every ordered pair of countries; one short loop over countries."""
        names = [(r.train, r.score) for r in splits.loco_pairs(feats.select("country").distinct()).collect()]
        return [(a, b, self.fit(feats.where(F.col("country") == a), roles.where(F.col("country") == a))) for a, b in names]
