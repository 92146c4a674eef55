"""What is read again and again: graphs held in memory, published versions, and feeds of changes."""

from __future__ import annotations

from collections import OrderedDict, deque
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class GraphCache:
    """The nodes and edges of the graphs used last, size of them at most, persisted; the one not used for longest makes room."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, size: int = 5):
        self.nodes, self.edges, self.size = nodes, edges, size
        self.held: OrderedDict[str, tuple[DataFrame, DataFrame]] = OrderedDict()

    def get(self, graph_id: str) -> tuple[DataFrame, DataFrame]:
        if graph_id not in self.held:
            self.held[graph_id] = tuple(df.where(F.col("graph_id") == graph_id).persist() for df in (self.nodes, self.edges))
            if len(self.held) > self.size:
                self.drop(next(iter(self.held)))
        self.held.move_to_end(graph_id)
        return self.held[graph_id]

    def drop(self, graph_id: str) -> None:
        """Forgets a graph, as after it was indexed anew."""
        for df in self.held.pop(graph_id, ()):
            df.unpersist()


class VersionedRead:
    """The newest published version of a table, read once and kept until a newer one is published."""

    def __init__(self, spark: SparkSession, root: str, name: str, read: Callable[[SparkSession, str, str], DataFrame]):
        self.spark, self.root, self.name, self.read = spark, root, name, read
        self.version, self.df = None, None

    def newest(self) -> int | None:
        """The version that a look at the pointers shows."""
        pointers = self.spark.read.text(f"{self.root}/_pointer_*")
        return pointers.agg(F.max(F.get_json_object("value", "$.version").cast("int"))).first()[0]

    def get(self) -> tuple[DataFrame, bool]:
        """The table, and whether it is newer than at the last look."""
        version = self.newest()
        changed = version != self.version
        if changed:
            self.version, self.df = version, self.read(self.spark, self.root, self.name)
        return self.df, changed


class Feed:
    """Hands messages to up to most clients, each with a queue of its own; one without news for beat seconds gets a heartbeat."""

    def __init__(self, most: int = 10, beat: float = 30.0):
        self.most, self.beat, self.clients, self.heard = most, beat, {}, {}

    def join(self, client: str, now: float) -> bool:
        """Whether there was room."""
        if client in self.clients or len(self.clients) >= self.most:
            return client in self.clients
        self.clients[client], self.heard[client] = deque(), now
        return True

    def leave(self, client: str) -> None:
        self.clients.pop(client, None)
        self.heard.pop(client, None)

    def publish(self, message: str, now: float) -> None:
        for client, queue in self.clients.items():
            queue.append(message)
            self.heard[client] = now

    def tick(self, now: float) -> None:
        for client, queue in self.clients.items():
            if now - self.heard[client] >= self.beat:
                queue.append(":heartbeat")
                self.heard[client] = now
