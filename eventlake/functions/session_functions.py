"""SQL functions for `spark.sql`: plain SQL expressions in the session catalog, which the optimizer unfolds into the query.

    register(spark)
    spark.sql("SELECT merkle_root(array_agg(sha)) FROM refs")
    spark.sql("SELECT * FROM lake WHERE cidr_match(src_ip, '10.0.0.0/8')")
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from eventlake.functions.net import IPV4

_PAIRS = (
    "aggregate(filter(sequence(0, 30), h -> shiftleft(1L, h) < size(leaves)), leaves, (level, _) -> "
    "transform(sequence(0, (size(level) - 1) div 2), i -> sha2(unhex(concat(get(level, CAST(2 * i AS INT)), "
    "coalesce(get(level, CAST(2 * i + 1 AS INT)), get(level, CAST(2 * i AS INT))))), 256)))"
)
_QUAD = IPV4.replace("\\", "\\\\")
# name -> (parameters, result, body)
FUNCTIONS = {
    # the address as a number, null where it is no IPv4 address
    "ip_number": (
        "ip STRING",
        "BIGINT",
        f"CASE WHEN ip RLIKE '{_QUAD}' THEN aggregate(split(ip, '[.]'), 0L, (n, part) -> n * 256 + CAST(part AS BIGINT)) END",
    ),
    # whether an IPv4 address lies in a network; null where the address or the network is none
    "cidr_match": (
        "ip STRING, cidr STRING",
        "BOOLEAN",
        "CASE WHEN try_cast(split_part(cidr, '/', 2) AS INT) BETWEEN 0 AND 32 THEN shiftright(ip_number(ip), 32 - try_cast(split_part(cidr, '/', 2) AS INT)) = "
        "shiftright(ip_number(split_part(cidr, '/', 1)), 32 - try_cast(split_part(cidr, '/', 2) AS INT)) END",
    ),
    # root of a Merkle tree over hex leaves in order; the last node of an odd level pairs with itself
    "merkle_root": ("leaves ARRAY<STRING>", "STRING", f"CASE WHEN size(leaves) > 0 THEN get({_PAIRS}, 0) END"),
    # hash of a pair of hex nodes, as the tree makes it
    "merkle_pair": ("lhs STRING, rhs STRING", "STRING", "sha2(unhex(concat(lhs, rhs)), 256)"),
}


def register(spark: SparkSession) -> SparkSession:
    """Put the functions into the session; again does no harm."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return spark
