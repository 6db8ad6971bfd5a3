"""Registration of queries beside their SQL twins."""


class Registry:
    def __init__(self):
        self.queries, self.oracle = {}, {}

    def query(self, sql: str | None = None):
        def add(fn):
            self.queries[fn.__name__] = fn
            if sql:
                self.oracle[fn.__name__] = sql
            return fn
        return add
