"""The registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.base import documents, table

MULTI_RANKS = "byte_bpe_multi_50k.tiktoken"
RANKS = "byte_bpe_50k.tiktoken"
TOKENIZER = "byte_bpe_50k.json"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the source field and of every line of every document."""
    from tessera.llm.bpe_fst import read_ranks
    from tessera.llm.token_counts import count_tokens
    return count_tokens(documents(spark, sf_dir), read_ranks(public_tokenizers.path(RANKS)), public_tokenizers.PATTERN,
                        fields=["source", "text"], rule="most")


def op2_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document and their decoding."""
    from tessera.llm.bpe_fst import encode_documents, read_ranks
    return encode_documents(documents(spark, sf_dir), read_ranks(public_tokenizers.path(MULTI_RANKS)),
                            public_tokenizers.PATTERN, with_ids=False)


def op3_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents by SimHash distance."""
    from tessera.llm.simhash import near_duplicates
    return near_duplicates(documents(spark, sf_dir))


def op4_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and weakly supervised verdict of every document."""
    from tessera.llm.quality import judge
    return judge(documents(spark, sf_dir))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents in Parquet files, and what these hold."""
    from tessera.llm.token_files import token_files
    with open(public_tokenizers.path(TOKENIZER), encoding="utf-8") as f:
        return token_files(documents(spark, sf_dir), f.read())


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows not held out."""
    from tessera.llm.langid import fit, identify
    docs = documents(spark, sf_dir)
    return identify(docs, fit(docs))


def op7_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document, weak ones by their credential."""
    from tessera.llm.secret_scan import find_secrets
    return find_secrets(documents(spark, sf_dir))


def op8_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item within the allowed edits."""
    from tessera.llm.decontam import contaminated
    return contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op9_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt and masked completions of every conversation and the same
    one with its neighbour's last answer."""
    from tessera.llm.preferences import exchanged_answers, format_pairs
    return format_pairs(exchanged_answers(table(spark, sf_dir, "conversations")))


def op10_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 100-byte strings that occur earlier."""
    from tessera.llm.rindex import remove_repeats
    return remove_repeats(documents(spark, sf_dir), with_text=False)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct prefix of the rebuilt conversations."""
    from tessera.llm.prefix_trie import prefix_nodes, rebuilt_turns
    return prefix_nodes(rebuilt_turns(table(spark, sf_dir, "conversations")))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from every source in each of 120 orders."""
    from tessera.llm.filter_audit import audit_documents
    return audit_documents(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op13_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document by word counts and by the
    probabilistic suffix tree, both learned from the rows not held out."""
    from tessera.llm.suffix_tree import score_documents
    return score_documents(documents(spark, sf_dir))


LLM_QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_bpe_transducer": op2_bpe_transducer,
    "op3_simhash_trie": op3_simhash_trie,
    "op4_quality_votes": op4_quality_votes,
    "op5_token_files": op5_token_files,
    "op6_language_id": op6_language_id,
    "op7_secret_links": op7_secret_links,
    "op8_benchmark_leaks": op8_benchmark_leaks,
    "op9_preference_pairs": op9_preference_pairs,
    "op10_run_index": op10_run_index,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_filter_audit": op12_filter_audit,
    "op13_suffix_tree": op13_suffix_tree,
}

LLM_ORACLES: dict[str, str] = {
    "op9_preference_pairs": """
        WITH rows AS (SELECT conv_id AS pair_id, turn, role, text FROM conversations),
        last AS (SELECT pair_id, max(turn) AS last_turn FROM rows WHERE role = 'assistant' GROUP BY pair_id),
        answer AS (SELECT l.pair_id, l.last_turn, max(r.text) AS text FROM last l
                   JOIN rows r ON r.pair_id = l.pair_id AND r.turn = l.last_turn AND r.role = 'assistant' GROUP BY 1, 2),
        sides AS (
            SELECT pair_id, turn, role, text, true AS c, false AS r FROM rows
            UNION ALL
            SELECT rows.pair_id, rows.turn, rows.role, rows.text, false, true FROM rows LEFT JOIN answer a USING (pair_id)
            WHERE NOT coalesce(rows.role = 'assistant' AND rows.turn = a.last_turn, false)
            UNION ALL
            SELECT a.pair_id, a.last_turn, 'assistant', o.text, false, true
            FROM answer a JOIN answer o ON o.pair_id = xor(a.pair_id, 1)),
        each AS (SELECT pair_id, turn, role, text, bool_or(c) AS c, bool_or(r) AS r FROM sides GROUP BY 1, 2, 3, 4),
        marked AS (SELECT *, bool_and(c AND r) OVER w AS common,
                          '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS rendered, length(role) + 5 AS head
                   FROM each WINDOW w AS (PARTITION BY pair_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)),
        placed AS (SELECT *, sum(CASE WHEN c AND NOT common THEN length(rendered) ELSE 0 END) OVER w AS c_end,
                          sum(CASE WHEN r AND NOT common THEN length(rendered) ELSE 0 END) OVER w AS r_end
                   FROM marked WINDOW w AS (PARTITION BY pair_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING))
        SELECT pair_id, sum(common::INT)::BIGINT AS n_prompt_turns,
               coalesce(string_agg(rendered, '' ORDER BY turn, role, text) FILTER (common), '') AS prompt,
               coalesce(string_agg(rendered, '' ORDER BY turn, role, text) FILTER (c AND NOT common), '') AS chosen,
               coalesce(string_agg(rendered, '' ORDER BY turn, role, text) FILTER (r AND NOT common), '') AS rejected,
               coalesce(string_agg((c_end - length(rendered) + head)::BIGINT || ':' || c_end::BIGINT, ',' ORDER BY turn, role, text)
                        FILTER (c AND NOT common AND role = 'assistant'), '') AS chosen_spans,
               coalesce(string_agg((r_end - length(rendered) + head)::BIGINT || ':' || r_end::BIGINT, ',' ORDER BY turn, role, text)
                        FILTER (r AND NOT common AND role = 'assistant'), '') AS rejected_spans
        FROM placed GROUP BY pair_id""",
    "op12_filter_audit": """
        WITH words AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
                              regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
                              doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS later FROM documents),
        masks AS (SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
                         + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT
                         + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(later, false)::INT AS mask FROM words),
        marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        cells AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
                  FROM masks LEFT JOIN marks USING (doc_id) GROUP BY part, mask),
        l AS (SELECT unnest([0, 1, 2, 3, 4]) AS f),
        orders AS (SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM l a, l b, l c, l d, l e
                   WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
        steps AS (SELECT array_to_string(list_transform(o, lambda x: substr('ABCDE', x + 1, 1)), '') AS filter_order,
                         unnest([1, 2, 3, 4, 5]) AS step, unnest(o) AS f, o FROM orders),
        bits AS (SELECT filter_order, step, f, list_sum(list_transform(o[1:step - 1], lambda x: (1 << x))) AS earlier FROM steps),
        outcome AS (SELECT part, filter_order, step, f,
                           sum(CASE WHEN mask & (coalesce(earlier, 0)::INT | (1 << f)) = 0 THEN n ELSE 0 END) AS kept,
                           sum(CASE WHEN mask & (1 << f) > 0 AND mask & coalesce(earlier, 0)::INT = 0 THEN n ELSE 0 END) AS removed,
                           sum(CASE WHEN mask & (1 << f) > 0 AND mask & coalesce(earlier, 0)::INT > 0 THEN n ELSE 0 END) AS redundant,
                           sum(CASE WHEN mask = (1 << f) THEN n ELSE 0 END) AS unique_fails,
                           sum(CASE WHEN mask & (1 << f) > 0 AND mask & coalesce(earlier, 0)::INT = 0 THEN good ELSE 0 END) AS good_lost,
                           sum(CASE WHEN mask & (1 << f) > 0 AND mask & coalesce(earlier, 0)::INT = 0 THEN toxic ELSE 0 END) AS toxic_lost
                    FROM cells, bits GROUP BY part, filter_order, step, f)
        SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
               redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
               toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM outcome""",
}
