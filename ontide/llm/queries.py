"""Named queries of the operators, and their SQL counterparts where SQL can express them."""

from __future__ import annotations

from ontide.llm import bpe, decontaminate, language_profiles, lexical_search, license_scan, pii
from ontide.llm import piece_counts, prefix_tree_join, quality_rules, spelling_variants
from ontide.llm import suffix_repeats, suffix_tree_lm, warc
from ontide.llm.common import table
from ontide.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]

WORD_BPE = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark, sf_dir):
    rows = quality_rules.clean_documents(table(spark, sf_dir, "documents"), with_text=False)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "lost_chars",
    )


def op2_suffix_repeats(spark, sf_dir):
    return suffix_repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.leak_report(decontaminate.find_leaks(docs, items))


def op4_token_counts(spark, sf_dir):
    path = tokenizer_path(PIECES)
    vocabulary, spare = piece_counts.piece_vocabulary(path), piece_counts.spare_pieces(path)
    return piece_counts.count_pieces(table(spark, sf_dir, "documents"), vocabulary, spare=spare)


def op5_warc(spark, sf_dir):
    rows = warc.round_trip(spark, table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_pii(spark, sf_dir):
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op7_license_scan(spark, sf_dir):
    rows = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "license", "containment")


def op8_bpe(spark, sf_dir):
    spec = bpe.read_spec(tokenizer_path(WORD_BPE))
    return bpe.token_digests(table(spark, sf_dir, "documents"), spec)


def op9_jaccard_join(spark, sf_dir):
    return prefix_tree_join.link_documents(table(spark, sf_dir, "documents"))


def op10_suffix_tree(spark, sf_dir):
    params = suffix_tree_lm.TreeParams(depth=3)
    return suffix_tree_lm.score_documents(table(spark, sf_dir, "documents"), params)


def op11_lexical_search(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return lexical_search.ranked_documents(docs, items)


def op12_spelling_variants(spark, sf_dir):
    words = spelling_variants.count_words(table(spark, sf_dir, "documents"), slip_one_in=199)
    return spelling_variants.spelling_groups(words)


def op13_language_profiles(spark, sf_dir):
    return language_profiles.identify_languages(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_suffix_repeats,
        op3_decontaminate,
        op4_token_counts,
        op5_warc,
        op6_pii,
        op7_license_scan,
        op8_bpe,
        op9_jaccard_join,
        op10_suffix_tree,
        op11_lexical_search,
        op12_spelling_variants,
        op13_language_profiles,
    )
}

