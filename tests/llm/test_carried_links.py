from chalkstream.llm.conversations import reply_links


def test_links_do_not_depend_on_where_blocks_end(spark):
    """The same talk within a block and over the end of one has the same links and scores."""
    said = [("tutor", "what are equivalent fractions like these?", "00:00:01"), ("student", "maybe decimals", "00:00:05"), ("tutor", "let us see", "00:01:00"), ("student", "equivalent fractions have equal values", "00:01:10"), ("student", "decimals then", "00:20:00"), ("tutor", "equal values", "00:20:02")]
    for cut_after in range(1, len(said)):
        rows = [(s, at + k, r, c, t) for s, at in (("near", 10), ("over", 4096 * 2 - cut_after)) for k, (r, c, t) in enumerate(said)]
        links = reply_links(spark.createDataFrame(rows, "session_id string, utterance_id long, role string, content string, ts string")).collect()
        seen = {s: sorted((x.pos - at, x.parent_pos and x.parent_pos - at, x.parent_score, x.crosses) for x in links if x.session_id == s) for s, at in (("near", 10), ("over", 4096 * 2 - cut_after))}
        assert seen["near"] == seen["over"]
