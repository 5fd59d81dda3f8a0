import hashlib

from docketry import registered


def test_the_digest_of_inconsistent_keys_holds_every_file(spark):
    d = "/root/testdata/sf0.001"
    files = {}
    for r in registered.a5_inconsistent_files(spark, d).collect():
        files.setdefault(r.routing_key, []).append((r.filename, r.service or ""))
    text = lambda own: "|".join("=".join(x for x in f if x) for f in sorted(own))
    want = {k: (hashlib.md5(text(own).encode()).hexdigest(), len(own)) for k, own in files.items()}
    assert {r.routing_key: (r.files, r.n_files) for r in registered.a5_routing_inconsistencies(spark, d).collect()} == want and want
