"""Short forms of history records."""


def commit(sha, email="a@x", date="2024-01-15T10:00:00Z", **more):
    return {"type": "commit", "sha": sha, "author_email": email, "author_name": email.split("@")[0], "author_date": date, **more}


def change(sha, path, add=1, delete=0, status="M", old=""):
    return {"type": "commit_file", "commit": sha, "path_current": path, "path_previous": old or path, "status": status, "additions": add, "deletions": delete}


def parent(sha, of):
    return {"type": "commit_parent", "sha": sha, "parent_sha": of}
