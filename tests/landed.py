"""Landed pages as a fetch function: a folder of JSON files, as tests write it."""

import json
import os


def page(video, parent, token):
    with open(os.path.join(os.environ["LANDED_PAGES"], f"{video}-{parent or 'top'}-{token or 1}.json")) as f:
        return json.load(f)


def broken():
    """A model that fails."""

    def run(texts):
        raise RuntimeError("no such weights")

    return run
