"""A sequential fold, event by event, to hold the set-at-a-time fold against."""

from __future__ import annotations


class Model:
    def __init__(self):
        self.files: dict[str, dict] = {}
        self.locations: dict[str, dict] = {}
        self.lengths: dict[bytes, int] = {}
        self.feed: list[tuple] = []

    def owner(self, path):
        hold = [x for x in self.locations.values() if x["removed_at_us"] is None and (path == x["path"] or path.startswith(x["path"] + "/"))]
        return max(hold, key=lambda x: len(x["path"]))["id"] if hold else None

    def apply(self, e):
        kind, path, at, seq = e["kind"], e.get("path"), e["at"], e["seq"]
        if kind in ("file_indexed", "file_modified"):
            old = self.files.get(path)
            self.files[path] = {"id": old["id"] if old else seq, "path": path, "size": e["size"], "mtime_us": e["mtime_us"], "root_hash": e["root_hash"], "deleted_at_us": None, "indexed_at_us": at, "chunks": e["chunks"]}
            for c in e["chunks"]:
                self.lengths.setdefault(c["hash"], c["length"])
        elif kind == "file_moved":
            f = self.files.get(e["from_path"])
            own = f["id"] if f else None
            if f and e["from_path"] != e["to_path"]:
                assert e["to_path"] not in self.files
                del self.files[e["from_path"]]
                self.files[e["to_path"]] = f | {"path": e["to_path"]}
            a, b = self.owner(e["from_path"]), self.owner(e["to_path"])
            if a is not None and a == b:
                self.feed.append((f"location:{a}", "moved_in", e["to_path"], own, a, seq))
            else:
                self.feed += [(f"location:{x}", k, p, own, x, seq) for k, p, x in (("moved_out", e["from_path"], a), ("moved_in", e["to_path"], b)) if x is not None]
        elif kind == "file_deleted":
            if path in self.files:
                self.files[path] |= {"deleted_at_us": at, "chunks": []}
        elif kind == "location_added":
            old = self.locations.get(path)
            self.locations[path] = {"id": old["id"] if old else seq, "path": path, "added_at_us": at, "removed_at_us": None, "scan_started_at_us": None, "last_scanned_at_us": None, "ignore_patterns": [], "index_mode": "shallow"}
        elif kind != "location_scan_progress" and path in self.locations:
            name = {"location_removed": "removed_at_us", "location_scan_started": "scan_started_at_us", "location_scan_completed": "last_scanned_at_us"}.get(kind)
            value = {name: at} if name else {"ignore_patterns": e["patterns"]} if kind == "location_ignore_set" else {"index_mode": e["mode"]}
            self.locations[path] |= value
        if kind in ("file_indexed", "file_modified", "file_deleted"):
            x = self.owner(path)
            if x is not None:
                self.feed.append((f"location:{x}", kind[5:], path, self.files[path]["id"] if path in self.files else None, x, seq))

    def references(self):
        n = dict.fromkeys(self.lengths, 0)
        for f in self.files.values():
            for c in f["chunks"]:
                n[c["hash"]] += 1
        return n


def random_log(r, n, moves):
    """A log that the reference accepts: moves never go onto a path that has a row."""
    model, out = Model(), []
    folders = ["/a", "/a/b", "/a/b/c", "/ab", "/d"]
    paths = [f"{f}/{k}" for f in folders for k in range(3)]
    kinds = ["file_indexed", "file_modified", "file_deleted"] * 3 + ["location_added"] * 2 + ["location_removed", "location_scan_started", "location_scan_completed", "location_scan_progress", "location_ignore_set", "location_mode_set"] + ["file_moved"] * (3 if moves else 0)
    for seq in range(1, n + 1):
        kind = r.choice(kinds)
        e = {"seq": seq, "kind": kind, "at": 1000 + r.randint(0, 50) + seq, "v": 1, "path": r.choice(paths if kind.startswith("file") else folders)}
        if kind == "file_moved":
            to = r.choice(paths)
            if to in model.files:
                e |= {"kind": "location_scan_progress", "path": "/a"}
            else:
                e |= {"from_path": e["path"], "to_path": to, "path": None}
        if e["kind"] in ("file_indexed", "file_modified"):
            chunks, at = [], 0
            for _ in range(r.randint(0, 3)):
                h = bytes([r.randint(0, 5)]) * 32
                chunks.append({"offset": at, "length": h[0] + 10, "hash": h})
                at += h[0] + 10
            e |= {"size": at, "mtime_us": seq * 1_000_000, "root_hash": bytes([seq % 256]) * 32, "chunks": chunks}
        elif kind == "location_ignore_set":
            e["patterns"] = [f"p{r.randint(0, 3)}"]
        elif kind == "location_mode_set":
            e["mode"] = r.choice(["shallow", "content"])
        model.apply(e)
        out.append(e)
    return out, model
