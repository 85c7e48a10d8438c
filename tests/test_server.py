"""The Flight server through a client, over the wire."""

import pyarrow as pa
import pyarrow.flight as fl
import pytest

from orrery.sources.engine import Engine
from orrery.sources.server import PREFIX, STATEMENT, SqlServer, fields, message, packed
from tests.harness import DATA


@pytest.fixture(scope="module")
def server(spark):
    with SqlServer(Engine(spark).register_parquet(DATA, ["nation", "orders"]), token="letmein", row_cap=30) as s:
        yield s


def ask(server, text, token="letmein", name=STATEMENT):
    with fl.connect(f"grpc://127.0.0.1:{server.port}") as client:
        options = fl.FlightCallOptions(headers=[(b"authorization", b"Bearer " + token.encode())])
        info = client.get_flight_info(fl.FlightDescriptor.for_command(packed(name, text)), options)
        return info.schema, client.do_get(info.endpoints[0].ticket, options).read_all()


def test_messages_round_trip():
    long = b"x" * 300
    assert fields(message((1, long), (2, b""))) == {1: long, 2: b""}
    assert fields(b"\x08\x96\x01" + message((2, b"abc"))) == {2: b"abc"}
    for bad in (b"\x0a\x05abc", b"\x80", b"\x0b"):
        with pytest.raises(ValueError):
            fields(bad)


def test_statement(server):
    schema, found = ask(server, "SELECT n_name, n_nationkey FROM nation QUALIFY ROW_NUMBER() OVER (ORDER BY n_nationkey) <= 3")
    assert found.column("n_nationkey").to_pylist() == [0, 1, 2]
    assert schema.names == found.schema.names and schema.types == found.schema.types


def test_refusals(server):
    with pytest.raises(fl.FlightUnauthenticatedError):
        ask(server, "SELECT 1 AS a", token="wrong")
    with pytest.raises((NotImplementedError, pa.ArrowNotImplementedError)):
        ask(server, "SELECT 1 AS a", name=PREFIX + "CommandGetTables")
    with pytest.raises(pa.ArrowInvalid):
        ask(server, "SELECT nothing FROM nowhere")
    with pytest.raises(fl.FlightServerError, match="too large"):
        ask(server, "SELECT o_orderkey FROM orders")
    with fl.connect(f"grpc://127.0.0.1:{server.port}") as client:
        options = fl.FlightCallOptions(headers=[(b"authorization", b"Bearer letmein")])
        with pytest.raises(pa.ArrowInvalid):
            client.do_get(fl.Ticket(b"\x80"), options).read_all()
        with pytest.raises((NotImplementedError, pa.ArrowNotImplementedError)):
            list(client.list_flights(options=options))
