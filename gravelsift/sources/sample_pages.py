"""Pages made up for trying out the paged source: endless, a comment and a reply on each."""


def page(video: str, parent: str | None, token: str | None) -> dict:
    n = int(token or 1)
    comment = {"id": f"{video}-{n}", "text": f"comment {n}", "author": "User1", "published_at": None, "total_replies": 1}
    return {"items": [comment | {"replies": [{"id": f"{video}-{n}-r", "text": "reply"}]}], "next": str(n + 1)}
