"""Stand-in for h5py where it is absent: a file is JSON, {read name: {"signal": [...], "channel": {...}, "tracking": {...}}}."""

import json

import numpy as np


class Group(dict):
    def __init__(self, members=(), **attrs):
        super().__init__(members)
        self.attrs = attrs

    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass


def File(path, mode):
    with open(path) as f:
        reads = json.load(f)
    out = Group()
    for name, r in reads.items():
        out[name] = Group({"Raw/Signal": np.array(r["signal"], np.int16)})
        if "channel" in r:
            out[name]["channel_id"] = Group(**r["channel"])
        if "tracking" in r:
            out[name]["tracking_id"] = Group(**r["tracking"])
    return out
