def records(frame):
    return [r.asDict() for r in frame.collect()]
