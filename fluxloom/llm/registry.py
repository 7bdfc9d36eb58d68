"""Queries of the corpus operators and the SQL that some of them are held against."""

from __future__ import annotations

from fluxloom.llm import chat, code_search, language_id, lexical_search, mixing, order_minhash, packing, prefix_trie, quality, simhash, substring, token_files, url_filter


def queries() -> dict:
    return {
        "op1_language_id": language_id.op1_language_id,
        "op2_pack": packing.op2_pack,
        "op3_mix_sources": mixing.op3_mix_sources,
        "op4_simhash": simhash.op4_simhash,
        "op5_url_filter": url_filter.op5_url_filter,
        "op6_chat_format": chat.op6_chat_format,
        "op7_code_search": code_search.op7_code_search,
        "op8_order_minhash": order_minhash.op8_order_minhash,
        "op9_quality": quality.op9_quality,
        "op10_substring_dedup": substring.op10_substring_dedup,
        "op11_lexical_search": lexical_search.op11_lexical_search,
        "op12_prefix_trie": prefix_trie.op12_prefix_trie,
        "op13_token_files": token_files.op13_token_files,
    }


def oracle_sql() -> dict:
    return {
        "op3_mix_sources": mixing.OP3_SQL,
        "op5_url_filter": url_filter.OP5_SQL,
        "op6_chat_format": chat.OP6_SQL,
        "op7_code_search": code_search.OP7_SQL,
        "op10_substring_dedup": substring.OP10_SQL,
        "op11_lexical_search": lexical_search.OP11_SQL,
        "op12_prefix_trie": prefix_trie.OP12_SQL,
    }
