"""SQL over Arrow Flight: ad-hoc statements of Flight SQL clients, with an optional bearer token.

A statement is analysed when a client asks for its place, which costs no job unless it recurses, and run
when it asks for its rows. One statement runs at a time. Other commands are answered as not implemented.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.flight as fl
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from orrery.errors import CapExceeded, EngineError, Unsupported
from orrery.sources.engine import RESULT_CAP, Engine

#: Bytes of Arrow that a client gets at most.
BYTES_CAP = 1 << 30
#: Planned statements that are held.
MOST_PLANNED = 64
#: Fixed values of the protocol: names of the messages for a statement and for the ticket of its rows.
PREFIX = "type.googleapis.com/arrow.flight.protocol.sql."
STATEMENT, TICKET = PREFIX + "CommandStatementQuery", PREFIX + "TicketStatementQuery"


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("a message ends inside a number")
        value |= (data[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if data[at - 1] < 128:
            return value, at


def fields(data: bytes) -> dict[int, bytes]:
    """The byte fields of a protobuf message by number; fields of other kinds are skipped."""
    found, at = {}, 0
    while at < len(data):
        tag, at = varint(data, at)
        kind = tag & 7
        if kind == 0:
            _, at = varint(data, at)
            continue
        n = {1: 8, 5: 4}.get(kind)
        if kind == 2:
            n, at = varint(data, at)
            found[tag >> 3] = data[at : at + n]
        if n is None or at + n > len(data):
            raise ValueError("not a message")
        at += n
    return found


def message(*parts: tuple[int, bytes]) -> bytes:
    out = bytearray()
    for number, value in parts:
        out.append(number << 3 | 2)
        n = len(value)
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        out.append(n)
        out += value
    return bytes(out)


def packed(name: str, text: str) -> bytes:
    """A statement, or the ticket of one, as a client or this server sends it."""
    return message((1, name.encode()), (2, message((1, text.encode()))))


def statement(data: bytes) -> str:
    """The SQL text of a command or ticket."""
    try:
        outer = fields(data)
        name, text = outer.get(1, b"").decode(), fields(outer.get(2, b"")).get(1, b"").decode()
    except ValueError as e:
        raise pa.ArrowInvalid(f"not a command: {e}") from e
    if name not in (STATEMENT, TICKET):
        raise NotImplementedError(f"command {name or 'without a name'}")
    return text


class _NoState(fl.ServerMiddleware):
    pass


class _Bearer(fl.ServerMiddlewareFactory):
    def __init__(self, token: str):
        self.expected = f"Bearer {token}".encode()

    def start_call(self, info, headers):
        import hmac

        sent = [v for k, vs in headers.items() if k.lower() == "authorization" for v in vs]
        if not any(hmac.compare_digest(v.encode() if isinstance(v, str) else v, self.expected) for v in sent):
            raise fl.FlightUnauthenticatedError("no valid bearer token")
        return _NoState()


class SqlServer(fl.FlightServerBase):
    def __init__(self, engine: Engine, location: str = "grpc://127.0.0.1:0", token: str | None = None, row_cap: int = RESULT_CAP, byte_cap: int = BYTES_CAP):
        super().__init__(location, middleware={"bearer": _Bearer(token)} if token else None)
        self.engine, self.row_cap, self.byte_cap = engine, row_cap, byte_cap
        self.one = threading.Lock()
        #: Statements that were planned for their schema and not fetched yet: recursion, say, is run by planning.
        self.planned: dict[str, DataFrame] = {}

    def _run(self, data: bytes, what):
        text = statement(data)
        try:
            with self.one:
                return text, what(text)
        except Unsupported as e:
            raise NotImplementedError(str(e)) from e
        except CapExceeded as e:
            raise fl.FlightServerError(f"too large: {e}") from e
        except (EngineError, PySparkException) as e:
            raise pa.ArrowInvalid(str(e)) from e

    def _schema(self, descriptor: fl.FlightDescriptor) -> tuple[str, pa.Schema]:
        if descriptor.descriptor_type != fl.DescriptorType.CMD:
            raise NotImplementedError("paths")
        return self._run(descriptor.command, lambda text: self._plan(text).limit(0).toArrow().schema)

    def _plan(self, text: str) -> DataFrame:
        found = self.planned[text] = self.engine.sql(text)
        while len(self.planned) > MOST_PLANNED:
            del self.planned[next(iter(self.planned))]
        return found

    def get_flight_info(self, context, descriptor):
        text, schema = self._schema(descriptor)
        # A place without a location is this server, by whatever name the client reached it.
        return fl.FlightInfo(schema, descriptor, [fl.FlightEndpoint(packed(TICKET, text), [])], -1, -1)

    def get_schema(self, context, descriptor):
        return fl.SchemaResult(self._schema(descriptor)[1])

    def do_get(self, context, ticket):
        _, found = self._run(ticket.ticket, self._fetch)
        return fl.RecordBatchStream(found)

    def _fetch(self, text: str) -> pa.Table:
        found = self.engine.fetch(self.planned.pop(text, text), self.row_cap)
        if found.nbytes > self.byte_cap:
            raise CapExceeded(f"more than {self.byte_cap} bytes")
        return found

    def list_flights(self, context, criteria) -> Iterator[fl.FlightInfo]:
        raise NotImplementedError("list_flights")

    def list_actions(self, context):
        raise NotImplementedError("list_actions")


def serve(engine: Engine, location: str = "grpc://0.0.0.0:50051", token: str | None = None) -> None:
    """Serves until the process ends."""
    with SqlServer(engine, location, token) as server:
        server.serve()
