"""A database for tests: a JSON file per database, changed by whole transactions.

It understands the statements of ``subflow.sinks.ledger`` and no others.
"""

import fcntl
import json
import re
from pathlib import Path


class Cursor:
    def __init__(self, connection):
        self.connection = connection

    def execute(self, sql, values):
        self.connection.todo.append((sql, [list(values)]))
        if sql.startswith("SELECT"):
            table = re.search(r"FROM (\w+)", sql)[1]
            self.found = [sum(r["batch_id"] == values[0] for r in self.connection.load()[table])]

    def executemany(self, sql, rows):
        self.connection.todo.append((sql, [list(r) for r in rows]))

    def fetchone(self):
        return self.found


class Connection:
    def __init__(self, path):
        self.path, self.todo = Path(path), []

    def load(self):
        return json.loads(self.path.read_text())

    def cursor(self):
        return Cursor(self)

    def commit(self):
        with open(f"{self.path}.lock", "w") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)
            tables = self.load()
            for sql, rows in self.todo:
                for values in rows:
                    self.run(tables, sql, values)
            self.path.write_text(json.dumps(tables))
        self.todo = []

    @staticmethod
    def run(tables, sql, values):
        if match := re.match(r"INSERT INTO (\w+) \((.*)\) VALUES", sql):
            row = dict(zip(match[2].split(", "), values, strict=True))
            if match[1] == "ledger" and row in tables["ledger"]:
                raise ValueError("the ledger has this batch")
            tables[match[1]].append(row)
        elif match := re.match(r"INSERT INTO (\w+) \((.*)\) SELECT .* FROM (\w+) WHERE (.*)", sql):
            names = re.findall(r"(\w+) = \?", match[4])
            found = [r for r in tables[match[3]] if [r[n] for n in names] == values]
            tables[match[1]] += [{c: r[c] for c in match[2].split(", ")} for r in found]
        elif match := re.match(r"DELETE FROM (\w+) WHERE (.*)", sql):
            names = re.findall(r"(\w+) = \?", match[2])
            tables[match[1]] = [r for r in tables[match[1]] if [r[n] for n in names] != values]

    def rollback(self):
        self.todo = []

    def close(self):
        pass


def create(path):
    Path(path).write_text(json.dumps({t: [] for t in ("staging", "ledger", "short", "long")}))


def connect(path):
    return Connection(path)
