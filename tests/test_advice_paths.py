"""All customers reach the conflict test, not only those that the catalogue makes clash."""

import pyarrow as pa
import pyarrow.parquet as pq
from tidewell import queries


def test_every_customer_is_tested(spark, tmp_path):
    names = [f"Customer#{i}" for i in range(60)]
    names[7], names[8] = "Twin", "twin"
    pq.write_table(pa.table({"c_custkey": pa.array(range(60), pa.int64()), "c_name": names}), tmp_path / "customer.parquet")
    got = {(r.path, r.conflict) for r in queries.Q["output_path_conflicts"](spark, str(tmp_path)).collect()}
    want = {(f"{n}{i}/x", "collision") for i in (0, 50) for n in ("Customer#", "CUSTOMER#")} | {("/1", "absolute"), ("/51", "absolute")}
    assert got == want | {("Twin/x", "collision"), ("twin/x", "collision")}
