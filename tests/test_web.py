import io
import json

from quillspark.engine import Engine
from quillspark.sources.store import MemoryStore
from quillspark.web import App


def test_http(spark):
    app = App(Engine(spark, MemoryStore()))

    def ask(method, path, body=b""):
        out = []
        data = b"".join(app({"REQUEST_METHOD": method, "PATH_INFO": path, "CONTENT_LENGTH": str(len(body)), "wsgi.input": io.BytesIO(body)}, lambda code, headers: out.append((int(code[:3]), dict(headers)))))
        return out[0][0], out[0][1]["Content-Type"], data

    assert ask("PUT", "/api/store/data/d/a.csv", b"n,s\n2,b\n1,a\n")[0] == 200
    assert ask("GET", "/q/-R/d/a.csv/-/ns-pl/sort-n/head-1/out.csv") == (200, "text/csv", b"n,s\n1,a\n")
    assert ask("PUT", "/api/store/data/d/a.csv", b"n,s\n0,z\n")[0] == 200
    assert ask("GET", "/q/-R/d/a.csv/-/ns-pl/sort-n/head-1/out.csv")[2] == b"n,s\n0,z\n", "the new file counts"
    assert ask("GET", "/api/store/data/d/a.csv")[2] == b"n,s\n0,z\n" and json.loads(ask("GET", "/api/store/listdir/d")[2]) == ["a.csv"] and json.loads(ask("GET", "/api/store/keys")[2]) == ["d/a.csv"]
    assert json.loads(ask("GET", "/api/store/contains/d/q")[2]) is False and json.loads(ask("GET", "/api/store/is_dir/d")[2]) is True
    ask("PUT", "/api/store/data/d/recipes.yaml", b"recipes:\n- -R/d/a.csv/-/ns-pl/nrows/n.csv\n")
    assert ask("GET", "/api/assets/data/d/n.csv")[2] == b"nrows\n1\n" and json.loads(ask("GET", "/api/recipes/listdir/d")[2]) == ["n.csv"]
    assert json.loads(ask("GET", "/api/recipes/data/d/n.csv")[2])["query"].endswith("n.csv") and json.loads(ask("GET", "/api/recipes/resolve/d/n.csv")[2]) == ["asset", "action", "filename"]
    assert json.loads(ask("GET", "/api/assets/metadata/d/a.csv")[2])["key"] == "d/a.csv" and json.loads(ask("POST", "/api/assets/cancel/d/none")[2]) == {"cancelled": False}
    assert ask("GET", "/q/a b")[0] == 400 and ask("GET", "/q/nothing")[0] == 404 and ask("GET", "/q/-R/no.csv")[0] == 404 and ask("PATCH", "/api/store/data/x")[0] == 501 and ask("GET", "/x")[0] == 404
    assert ask("DELETE", "/api/store/data/d/a.csv")[0] == 200 and ask("GET", "/api/store/data/d/a.csv")[0] == 404
