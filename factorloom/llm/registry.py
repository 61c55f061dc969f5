"""The queries of the numbered operators, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from . import alignment, bpe, brown, exact_dedup, langid, licenses, minhash, mixing, mpegts, pii, runs, secrets, urlrules
from .common import documents

QUERIES = {
    "op1_bpe": lambda spark, sf_dir: bpe.digests(documents(spark, sf_dir)),
    "op2_near_duplicates": lambda spark, sf_dir: minhash.near_components(documents(spark, sf_dir)),
    "op3_secret_scan": lambda spark, sf_dir: secrets.digest(secrets.scan(documents(spark, sf_dir))),
    "op4_language_id": lambda spark, sf_dir: langid.identify(documents(spark, sf_dir)),
    "op5_license_scan": lambda spark, sf_dir: licenses.scan(documents(spark, sf_dir)),
    "op6_transport_stream": lambda spark, sf_dir: mpegts.demux(mpegts.mux(documents(spark, sf_dir))),
    "op7_class_language_model": lambda spark, sf_dir: brown.score(documents(spark, sf_dir)),
    "op8_exact_dedup": lambda spark, sf_dir: exact_dedup.exact_dedup(documents(spark, sf_dir)),
    "op9_mix_sources": lambda spark, sf_dir: mixing.mix(documents(spark, sf_dir)),
    "op10_personal_data": lambda spark, sf_dir: pii.detect(documents(spark, sf_dir)),
    "op11_periodic_runs": lambda spark, sf_dir: runs.digests(documents(spark, sf_dir)),
    "op12_url_rules": lambda spark, sf_dir: urlrules.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), urlrules.rule_table(spark)),
    "op13_tokenizer_alignment": lambda spark, sf_dir: alignment.align(documents(spark, sf_dir)),
}
SQL = {
    "op3_secret_scan": secrets.sql(),
    "op5_license_scan": licenses.sql(),
    "op8_exact_dedup": exact_dedup.SQL,
    "op12_url_rules": urlrules.sql(),
}
