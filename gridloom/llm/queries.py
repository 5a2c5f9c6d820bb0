"""The operators as queries over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from gridloom.llm import chat, decontaminate, html_main, language, minhash_forest, mixing, ngram_join, periodic, prefix_trie, secrets, spotsigs, url_filter, warc


def queries() -> dict:
    made = (
        mixing.op1_mix_sources, warc.op2_warc_derivatives, decontaminate.op3_decontaminate, url_filter.op4_url_filter, html_main.op5_html_main_text,
        chat.op6_chat_format, minhash_forest.op7_minhash_forest, spotsigs.op8_spotsigs, secrets.op9_secret_scan, language.op10_language_id,
        ngram_join.op11_ngram_join, prefix_trie.op12_prefix_trie, periodic.op13_periodic_runs,
        # Parts of the above that SQL can express.
        url_filter.url_rules, spotsigs.spotsigs_edits, secrets.secret_base_spans,
    )
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mix_sources": mixing.OP1_SQL, "op6_chat_format": chat.OP6_SQL, "op7_minhash_forest": minhash_forest.OP7_SQL, "op11_ngram_join": ngram_join.OP11_SQL, "op12_prefix_trie": prefix_trie.OP12_SQL, "url_rules": url_filter.URL_RULES_SQL,
        "spotsigs_edits": spotsigs.SPOTSIGS_EDITS_SQL, "secret_base_spans": secrets.SECRET_BASE_SPANS_SQL,
    }
