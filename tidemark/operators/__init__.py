"""DataFrame -> DataFrame operators over postings and their skill evidence.

Column conventions
    postings: posting_id, company_id, company_name, source_id, status, title, career_type,
              sector, location, first_seen_at, last_verified_at, closes_at
    evidence: posting_id, skill, category, requirement_type, confirmed
Operators use the columns they need and leave the physical plan to Catalyst:
no hints, as no side of a join has a size that is known to stay small.
"""
