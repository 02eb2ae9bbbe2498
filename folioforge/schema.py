"""Fixed schemas. Missing text is the empty string, never null."""

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    kinds = {"long": T.LongType(), "string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "timestamp": T.TimestampType(), "binary": T.BinaryType(), "map": T.MapType(T.StringType(), T.StringType())}
    return T.StructType([T.StructField(n, kinds[k.rstrip("?")], k.endswith("?")) for n, k in (x.split(":") for x in spec.split())])


BOOKS = _struct("id:long title:string author:string year:string city:string category:string source:string")
STATE = _struct("key:string value:string")
MISSES = _struct("id:long reason:string seen_at:timestamp")
RESPONSES = _struct("id:long attempt:int status:int? headers:map? body:binary? error:string?")
OUTCOMES = _struct("seq:long id:long reason:string detail:string")

#: Reasons (fixed values): every outcome, those that mean a failed request, a refusal, and a confirmed gap.
REASONS = ["ok", "http-403", "http-404", "http-429", "http-5xx", "http-other", "timeout", "network", "challenge", "blocked-page", "no-title", "dead-title", "not-hebrew", "empty-body"]
HARD = ["http-403", "http-429", "http-5xx", "timeout", "network", "challenge", "blocked-page"]
REFUSED = ["http-403", "http-429", "challenge", "blocked-page"]
GAPS = ["http-404", "dead-title"]
