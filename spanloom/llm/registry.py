"""Queries of this package, by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from .chat import OP4_SQL, op4_chat
from .differencing import op11_even_windows
from .html_text import op1_html_text
from .language_id import op9_language_id
from .ogg import op6_media
from .packing import op7_packing
from .pieces import op2_sentencepiece
from .prefix_trie import OP13_SQL, op13_prefix_trie
from .quality import op5_quality
from .secret_scan import op8_secrets
from .simhash import op10_simhash
from .token_links import op12_token_links
from .warc import OP3_SQL, op3_warc

QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_warc": op3_warc,
    "op4_chat": op4_chat,
    "op5_quality": op5_quality,
    "op6_media": op6_media,
    "op7_packing": op7_packing,
    "op8_secrets": op8_secrets,
    "op9_language_id": op9_language_id,
    "op10_simhash": op10_simhash,
    "op11_even_windows": op11_even_windows,
    "op12_token_links": op12_token_links,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES: dict[str, str] = {"op3_warc": OP3_SQL, "op4_chat": OP4_SQL, "op13_prefix_trie": OP13_SQL}
