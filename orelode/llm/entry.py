"""The queries of the training-data operators and their reference SQL."""

from __future__ import annotations

from orelode.llm import bpe, convrepair, digest, embeddings, exactdedup, langid, mixing, ngramlm, simhash, timeparts, toxicity, urlfilter, warc

QUERIES = {
    "op1_langid": langid.op1_langid,
    "op2_fingerprint": digest.op2_fingerprint,
    "op3_urlfilter": urlfilter.op3_urlfilter,
    "op4_mixing": mixing.op4_mixing,
    "mixing_targets": mixing.mixing_targets,
    "op5_bpe": bpe.op5_bpe,
    "op6_ngramlm": ngramlm.op6_ngramlm,
    "op7_warc": warc.op7_warc,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_simhash": simhash.op9_simhash,
    "op10_embeddings": embeddings.op10_embeddings,
    "op11_timeparts": timeparts.op11_timeparts,
    "op12_exactdedup": exactdedup.op12_exactdedup,
    "op13_convrepair": convrepair.op13_convrepair,
}

ORACLES: dict[str, str] = {
    "op3_urlfilter": urlfilter.ORACLE,
    "mixing_targets": mixing.TARGETS_ORACLE,
    "op7_warc": warc.ORACLE,
    "op10_embeddings": embeddings.ORACLE,
    "op12_exactdedup": exactdedup.ORACLE,
}
