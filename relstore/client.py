"""A client of the TCP server."""

from __future__ import annotations

import socket

from . import wire
from .result import CommandResult
from .server import receive_frame


class Client:
    def __init__(self, address: tuple[str, int], timeout: float | None = None):
        self._socket = socket.create_connection(address, timeout)
        self._request = 0
        self._socket.sendall(wire.pack_frame(wire.Frame(wire.HELLO, 0)))
        f = receive_frame(self._socket)
        if f != wire.Frame(wire.HELLO_ACK, 0):
            raise wire.ProtocolError("expected HELLO_ACK")

    def __enter__(self) -> Client:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        self._socket.close()

    def execute(self, sql: str | bytes) -> CommandResult | wire.Rows:
        """A result; a statement's error is raised as RelError and leaves the connection usable."""
        data = sql.encode("utf-8", "surrogatepass") if isinstance(sql, str) else sql
        if len(data) > wire.MAX_SQL:
            raise wire.ProtocolError("the statement exceeds the limit")
        self._request += 1
        self._socket.sendall(wire.pack_frame(wire.Frame(wire.EXECUTE_SQL, self._request, data)))
        f = receive_frame(self._socket)
        if f.kind == wire.ERROR_RESPONSE:
            raise wire.unpack_error(f.payload)
        if f.request != self._request:
            raise wire.ProtocolError("the answer is to another request")
        if f.kind == wire.COMMAND_RESULT:
            return wire.unpack_command(f.payload)
        if f.kind == wire.SELECT_RESULT:
            return wire.unpack_select(f.payload)
        raise wire.ProtocolError("unexpected message")
