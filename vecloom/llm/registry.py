"""The queries of this subpackage and the SQL that checks them, for __spark_entry__.py."""

from __future__ import annotations

from . import fingerprints, language, lattice, licenses, packing, pseudonyms, sentencepieces, sharding, simhash, url_filters

QUERIES = {
    "op1_fingerprints": fingerprints.op1_fingerprints,
    "op2_pseudonyms": pseudonyms.op2_pseudonyms,
    "op3_simhash": simhash.op3_simhash,
    "op4_lattice": lattice.op4_lattice,
    "op5_language": language.op5_language,
    "op6_url_filters": url_filters.op6_url_filters,
    "op7_licenses": licenses.op7_licenses,
    "op8_sentencepieces": sentencepieces.op8_sentencepieces,
    "op9_packing": packing.op9_packing,
    "op10_sharding": sharding.op10_sharding,
}

SQL = {
    "op1_fingerprints": fingerprints.OP1_SQL,
    "op4_lattice": lattice.OP4_SQL,
    "op6_url_filters": url_filters.OP6_SQL,
    "op7_licenses": licenses.OP7_SQL,
}
